"""Plain models that several tests compare with."""

from veilframe.operators.registry import Registry


def fold_task(texts, prompt_first=False):
    """(masked, tokens, characters) of a task's texts in order."""
    registry = Registry()
    return [registry.mask(t or "", prompt=prompt_first and i == 0) for i, t in enumerate(texts)]
