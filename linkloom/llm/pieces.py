"""Values of text pieces that a worker remembers between batches and tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Remembered:
    """A map from pieces to values, filled by ``compute`` for the pieces it lacks.

    It stops growing at ``most`` pieces; frequent ones come early, so they are in.
    Pieces met later are computed for the group of texts at hand and dropped with it.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int):
        self.compute, self.most = compute, most
        self.values: dict = {}
        self.extra: list[str] = []

    def group(self, pieces: list[str]) -> dict:
        """A map with the values of these pieces (and of others), good until the next call."""
        for piece in self.extra:
            del self.values[piece]
        new = list(set(pieces).difference(self.values))
        self.values.update(zip(new, self.compute(new), strict=True))
        self.extra = new if len(self.values) > self.most else []
        return self.values

    def each(self, pieces: list[str]) -> list:
        """The values of these pieces, all different, in order."""
        found = list(map(self.values.get, pieces))
        places = [k for k, value in enumerate(found) if value is None]
        new = [pieces[k] for k in places]
        made = list(self.compute(new))
        for k, value in zip(places, made, strict=True):
            found[k] = value
        if len(self.values) < self.most:
            self.values.update(zip(new, made, strict=True))
        return found


_kept: dict = {}


def once(key, make: Callable):
    """``make()``, once in a worker process for each key."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
