"""veilframe.sources"""
