"""What surrounds queries: views by name, result caches, first contents, saved results, reports."""

from __future__ import annotations

import html
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.entities import ENTITIES, TABLES, frame


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Temporary views of all base tables and entities, so that SQL can name them."""
    names = [*TABLES, *ENTITIES]
    for n in names:
        frame(spark, sf_dir, n).createOrReplaceTempView(prefix + n)
    return [prefix + n for n in names]


class ResultCache:
    """The last few results, persisted by Spark and dropped when they are old or pushed out."""

    def __init__(self, size: int = 10, seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict[object, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self.held:
            at, df = self.held.pop(key)
            if self.clock() - at <= self.seconds:
                self.held[key] = (at, df)
                return df
            df.unpersist()
        df = make().persist()
        self.held[key] = (self.clock(), df)
        while len(self.held) > self.size:
            self.held.popitem(last=False)[1][1].unpersist()
        return df

    def clear(self) -> None:
        for _, df in self.held.values():
            df.unpersist()
        self.held.clear()


def bootstrap(current: DataFrame, sample: DataFrame) -> DataFrame:
    """The current rows, or the sample's where there are none."""
    return sample.select(*current.columns) if current.isEmpty() else current


def line(columns: list[str], style: str) -> Column:
    """A row as a line of text, markdown or HTML; null shows as nothing."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    if style == "markdown":
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    if style == "html":
        safe = [F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) for c in cells]
        return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *safe), F.lit("</td></tr>"))
    return F.concat_ws("\t", *cells)


def report(rows: DataFrame, style: str = "text", most: int = 20) -> str:
    """The first rows of a ranked result as text, markdown or HTML."""
    head, body = rows.columns, [["" if v is None else str(v) for v in r] for r in rows.limit(most).collect()]
    if style == "markdown":
        return "\n".join("| " + " | ".join(x) + " |" for x in (head, ["---"] * len(head), *body))
    if style == "html":
        cells = lambda tag, x: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in x) + "</tr>"
        return "<table>" + cells("th", head) + "".join(cells("td", x) for x in body) + "</table>"
    return "\n".join("\t".join(x) for x in (head, *body))
