"""Report text of an item: a headline, what it means and what to do next. Never a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.params import NEXT_STEPS, TEXTS


def filled(template: Column, n: Column, k: Column, label: Column) -> Column:
    for name, value in (("{n}", n.cast("string")), ("{k}", k.cast("string")), ("{label}", label)):
        template = F.replace(template, F.lit(name), value)
    return template


def conclusion(pattern: Column, n: Column, k: Column, label: Column) -> Column:
    """Struct (headline, detail, next_steps) of an item with ``n`` parts, ``k`` of them elevated, and the label of its band."""
    kind = F.when(n == 0, "no_part").otherwise(pattern)
    text = lambda i: F.element_at(F.create_map(*[F.lit(x) for name, t in TEXTS.items() for x in (name, t[i])]), kind)
    then = F.when(n == 0, NEXT_STEPS["no_part"]).when(k == 0, NEXT_STEPS["quiet"]).when(k == 1, NEXT_STEPS["raised_one"]).otherwise(NEXT_STEPS["raised"])
    parts = {"headline": text(0), "detail": text(1), "next_steps": then}
    return F.struct(*[filled(t, n, k, label).alias(name) for name, t in parts.items()])
