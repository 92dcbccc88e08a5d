"""Running aggregates along positions, in pieces, so that no window holds a whole chromosome or track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staged import dealt, staged

#: Positions per piece.
PIECE = 1_000_000
#: Pieces of one key that one window takes, and pieces per piece where there are more.
MANY, NESTED = 1_000_000, 1000
#: Aggregates that can be put together from pieces, and how.
_KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def scan(rows: DataFrame, keys: tuple[str, ...], measures: dict[str, tuple], pos: str = "pos", ties: tuple[str, ...] = (), itself: bool = True, after: bool = False, piece: int | None = None) -> DataFrame:
    """rows with running aggregates in the order of ``pos`` and ``ties`` within the keys.

    measures: name -> (sum, max or min; what of), and perhaps a dict with an ``itself`` and an ``after`` of its own. A row counts
    itself if ``itself``; with ``after`` the rows behind it count instead of those before. Sums begin at 0, the others at null.
    The rows are written as a table once (unless they are one), as they are read twice: each piece of positions is aggregated,
    a small window over the pieces carries what came before or behind, and a window inside each piece adds the rest. Tasks are
    sized by rows; where positions are so wide that there are many pieces, these are scanned in pieces of their own.
    """
    table = staged(rows, "scan")
    n = table.count()
    cut = table.withColumn("_piece", F.floor(F.col(pos) / (piece or PIECE))).withColumns({f"_v_{name}": c for name, (_, c, *_) in measures.items()})
    totals = cut.groupBy(*keys, "_piece").agg(*(_KINDS[m[0]][0](f"_v_{name}").alias(f"_t_{name}") for name, m in measures.items()))
    at, carried, found = [*keys, "_piece"], [], {}
    for name, (kind, _, *own) in measures.items():
        how = {"itself": itself, "after": after} | (own[0] if own else {})
        turn = (lambda c: F.col(c).desc()) if how["after"] else F.col
        earlier = W.partitionBy(*keys).orderBy(turn("_piece")).rowsBetween(W.unboundedPreceding, -1)
        inside = W.partitionBy(*at).orderBy(*map(turn, (pos, *ties))).rowsBetween(W.unboundedPreceding, 0 if how["itself"] else -1)
        make, join = _KINDS[kind]
        carried.append((f"_o_{name}", kind, F.col(f"_t_{name}"), how | {"itself": False}, earlier))
        found[name] = join(F.col(f"_o_{name}"), make(f"_v_{name}").over(inside))
    if n > MANY:
        totals = staged(totals, "totals")
    if n > MANY and (totals.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > MANY:
        before = scan(totals.withColumnRenamed("_piece", "_at"), keys, {o: (kind, t, how) for o, kind, t, how, _ in carried}, pos="_at", piece=NESTED).withColumnRenamed("_at", "_piece")
    else:
        before = totals.withColumns({o: _KINDS[kind][0](t).over(earlier) for o, kind, t, _, earlier in carried})
    before = before.select(*at, *(o for o, *_ in carried))
    return dealt(cut, n, *at).join(before, at).withColumns(found).select(*rows.columns, *measures)
