"""veilframe.functions"""
