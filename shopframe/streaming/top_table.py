"""A ranking kept current from changed totals.

Totals live in a change log. Its manifest carries the ranking's candidates, the
best ``keep`` keys, and a floor: no other key ranks before it. A batch that
changed some totals looks at those rows only: they are merged into the
candidates, and what drops out raises the floor. A candidate whose total falls
below the floor is let go, as an unseen key may rank before it; only when fewer
than ``n`` candidates are left are the totals read again. The first ``n`` are
exact after every batch, and what the driver holds is ``keep`` keys and totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changelog import ChangeLog


def _rank(entry):
    """Larger totals first, then smaller keys."""
    return (-entry[0], entry[1])


def merge(note: dict | None, changed: list, keep: int) -> dict:
    """Candidates and floor after some totals changed: ``changed`` has (total,
    key) of every changed candidate and the ``keep + 1`` best changed keys."""
    note = note or {"top": [], "floor": None}
    new = {k: t for t, k in changed}
    entries = sorted([[new.pop(k, t), k] for t, k in note["top"]] + [[t, k] for k, t in new.items()], key=_rank)
    floor = note["floor"]
    sure = [e for e in entries if floor is None or _rank(e) < _rank(floor)]
    out = entries[len(sure):] + sure[keep:]
    floors = [e for e in [floor, *out] if e is not None]
    return {"top": sure[:keep], "floor": min(floors, key=_rank) if floors else None}


class TopTable:
    def __init__(self, log: ChangeLog, total_col: str, n: int, keep: int | None = None):
        (self.key,) = log.key
        self.log, self.total, self.n = log, total_col, n
        self.keep = keep or 4 * n + 16
        self.rebuilt = 0

    def update(self, changed: DataFrame, epoch: int) -> None:
        """Take the changed keys' new totals (key, total)."""
        self.log.append(changed.select(self.key, self.total), epoch, self._note)

    def _best(self, rows: DataFrame) -> list:
        rows = rows.orderBy(F.desc(self.total), F.col(self.key)).limit(self.keep + 1)
        return [[r[1], r[0]] for r in rows.select(self.key, self.total).collect()]

    def _note(self, changed: DataFrame) -> dict:
        now = self.log.manifest()
        note = now["note"] if now else None
        some = self._best(changed)
        if note:
            own = changed.where(F.col(self.key).isin([k for _, k in note["top"]]))
            some += [e for e in ([r[1], r[0]] for r in own.select(self.key, self.total).collect()) if e not in some]
        note = merge(note, some, self.keep)
        if len(note["top"]) < self.n and note["floor"] is not None:
            self.rebuilt += 1
            before = self.log.latest()
            rows = changed if before is None else before.join(changed, self.key, "left_anti").unionByName(changed)
            note = merge(None, self._best(rows), self.keep)
        return note

    def top(self) -> list:
        """(key, total) of the first ``n``."""
        now = self.log.manifest()
        return [(k, t) for t, k in now["note"]["top"][:self.n]] if now else []
