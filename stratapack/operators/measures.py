"""Analytics over benchmark measurements: (date, adapter, ord, name, input, bytes, gbps, ratio, timing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many runs the history shows.
HISTORY_RUNS = 8


def shown(input_: Column) -> Column:
    """Whole corpora and synthetic inputs; a corpus's single files stay hidden."""
    return ~input_.contains("/") | input_.endswith("/all")


def gbps(bytes_: Column, seconds: Column) -> Column:
    return bytes_ / seconds / F.lit(1e9)


def ms(bytes_: Column, rate: Column) -> Column:
    return bytes_ / (rate * F.lit(1e9)) * F.lit(1e3)


def medians(samples: DataFrame, keys: list[str], value: str, order: str | None = None, warmup: int = 0) -> DataFrame:
    """Median of each group, the first `warmup` samples by order (unique in a group) left out."""
    if warmup:
        # Spark keeps the first rows of each group in every task, so no task ranks a whole group.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        first = samples.select(*keys, order).withColumn("_place", place).filter(F.col("_place") <= warmup)
        cut = first.groupBy(*keys).agg(F.max(order).alias("_cut")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_cut")
        same = [samples[k].eqNullSafe(cut[f"_{k}"]) for k in keys]
        samples = samples.join(cut, same).filter(F.col(order) > F.col("_cut")).select(*samples.columns)
    return exact_medians(samples, keys, value)


def exact_medians(samples: DataFrame, keys: list[str], value: str, accuracy: int = 1000) -> DataFrame:
    """medians() for groups of any size: a sketch brackets the middle of each group, and only what lies in the bracket is kept and ranked.

    keys, median. Nulls are left out. About 2 / accuracy of a group lies in its bracket (more only if values repeat; those
    are counted, not kept).
    """
    held = samples.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edge = 1 / accuracy
    sketch = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [0.5 - 2 * edge, 0.5 + 2 * edge], accuracy).alias("_q"))
    marked = held.alias("a").join(sketch.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select(*[F.col(f"a.{k}").alias(k) for k in keys], "_v", "_n", "_q")
    # The sketch's error is at most 1 / accuracy of the rows, so the middle lies between its two values.
    inside = (F.col("_v") >= F.col("_q")[0]) & (F.col("_v") <= F.col("_q")[1])
    counted = marked.groupBy(*keys, F.when(inside, F.col("_v")).alias("_v"), F.when(~inside, F.col("_v") < F.col("_q")[0]).alias("_below")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(F.when(F.col("_below"), 0).when(F.col("_v").isNotNull(), 1).otherwise(2), "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto)).filter("_v IS NOT NULL")
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    return ranked.groupBy(*keys).agg(((holds(low) + holds(high)) / 2).alias("median"))


def ratio(original: Column, packed: Column) -> Column:
    return original / packed


def appended(*suites: DataFrame) -> DataFrame:
    """The measurement lists of all suites after one another, none dropped; ord goes on where the suite before ended."""
    out = None
    for k, suite in enumerate(suites):
        rows = suite.withColumn("suite", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    sizes = out.groupBy("suite").agg((F.max("ord") + 1).alias("n"))
    begin = sizes.select("suite", F.coalesce(F.sum("n").over(Window.orderBy("suite").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    return out.join(begin, "suite").withColumn("ord", F.col("ord") + F.col("begin")).drop("suite", "begin")


def corpora_last(meas: DataFrame) -> DataFrame:
    """A corpus's rows in the order measured, concatenations behind them."""
    return meas.orderBy(F.col("input").endswith("/all"), "ord")


def tradeoff(meas: DataFrame, input_: str) -> DataFrame:
    """name, gbps, ratio, pareto of one input: the first row of each name, the fastest first (then by ratio and name)."""
    rows = first_rows(meas.filter((F.col("input") == input_) & F.col("ratio").isNotNull()), ["name"]).select("name", "gbps", "ratio")
    best = pareto(rows, "ratio", "gbps").select(F.col("name").alias("_name")).distinct()
    marked = rows.join(best, rows["name"] == best["_name"], "left").withColumn("pareto", F.col("_name").isNotNull()).drop("_name")
    return marked.orderBy(F.desc("gbps"), F.desc("ratio"), "name")


def history_matrix(meas: DataFrame, keep: int = HISTORY_RUNS) -> DataFrame:
    """name, input and one column for each of the last `keep` runs (oldest first, by date): the first rate measured, or null.

    Each name has one input, its preferred one in the newest run that has the name. Names are in the order of the newest run, others
    behind it. Only shown inputs count. At most `keep` dates are collected.
    """
    rows = meas.filter(shown(F.col("input")))
    dates = [r["date"] for r in rows.select("date").distinct().orderBy(F.desc("date")).limit(keep).collect()][::-1]
    if not dates:
        return rows.select("name", "input").limit(0)
    recent = rows.filter(F.col("date").isin(dates))
    prefer = F.when(F.col("input").endswith("/all"), 0).when(F.col("input") == "text", 1).otherwise(2)
    newest = recent.groupBy("name", "date").agg(F.min_by("input", F.struct(prefer, "ord")).alias("input"))
    chosen = newest.groupBy("name").agg(F.max_by("input", "date").alias("input"))
    place = recent.filter(F.col("date") == dates[-1]).groupBy("name").agg(F.min("ord").alias("_place"))
    cells = recent.join(chosen, ["name", "input"]).groupBy("name", "input").pivot("date", dates).agg(F.min_by("gbps", "ord"))
    return cells.join(place, "name", "left").orderBy(F.col("_place").isNull(), "_place", "name").drop("_place")


#: Parts of a report, and which measurements each shows: by timing, name and input.
SECTIONS = {
    "setup": None,
    "versus": None,
    "compress": "name LIKE 'compress%' AND input LIKE '%/all'",
    "decompress": "name LIKE 'decompress%' AND input LIKE '%/all'",
    "files-compress": "name LIKE 'compress%' AND input LIKE '%/%'",
    "files-decompress": "name LIKE 'decompress%' AND input LIKE '%/%'",
    "file-to-file": "name LIKE 'file%'",
    "synthetic-compress": "name LIKE 'compress%' AND input NOT LIKE '%/%' AND input NOT LIKE '%-%'",
    "synthetic-decompress": "name LIKE 'decompress%' AND input NOT LIKE '%/%' AND input NOT LIKE '%-%'",
    "numeric": "input NOT LIKE '%/%' AND input LIKE '%-%'",
    "profile": "name LIKE 'stage%'",
    "platform": None,
}


def report_sections(meas: DataFrame, pairs: DataFrame, facts: dict[str, str]) -> dict[str, str]:
    """Markdown of every section that something was measured for. facts: what setup and platform list.

    The rows of a section are names and inputs of one run, so few; each section is one query.
    """
    out = {}
    for name, rule in SECTIONS.items():
        if name in ("setup", "platform"):
            rows, columns = [{"what": k, "value": v} for k, v in facts.items() if (name == "platform") == k.startswith("platform.")], ["what", "value"]
        elif name == "versus":
            columns = ["label", "input", "our_gbps", "their_gbps", "quotient"]
            rows = [r.asDict() for r in versus(meas, pairs).orderBy("label", "input").select(*columns).collect()]
        elif name in ("compress", "decompress"):
            columns = ["name", "gbps", "ratio", "pareto"]
            inputs = [r["input"] for r in meas.filter(rule).select("input").distinct().orderBy("input").collect()]
            rows = [r.asDict() for i in inputs[:1] for r in tradeoff(meas.filter(rule), i).collect()]
        else:
            columns = ["name", "input", "gbps", "ratio"]
            rows = [r.asDict() for r in corpora_last(first_rows(meas.filter(rule), ["name", "input"])).select(*columns).collect()]
        if rows:
            out[name] = markdown(rows, columns)
    return out


def first_rows(meas: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key in the order measured."""
    others = [c for c in meas.columns if c not in keys]
    best = meas.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(order)).alias("r"))
    return best.select(*keys, "r.*")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Per adapter, the newest run that measured a corpus, else the newest. runs has has_corpus."""
    others = [c for c in runs.columns if c != "adapter"]
    return runs.groupBy("adapter").agg(F.max_by(F.struct(*others), F.struct("has_corpus", "date")).alias("r")).select("adapter", "r.*")


def history(runs: DataFrame, keep: int = HISTORY_RUNS) -> DataFrame:
    """The last `keep` runs of each adapter, with their age (1: newest)."""
    age = F.row_number().over(Window.partitionBy("adapter").orderBy(F.desc("date")))
    return runs.withColumn("age", age.cast("long")).filter(F.col("age") <= keep)


def matrix(meas: DataFrame, inputs: list[str]) -> DataFrame:
    """name x input, the first measurement in each cell."""
    return meas.groupBy("name").pivot("input", inputs).agg(F.min_by("gbps", "ord"))


def pareto(points: DataFrame, x: str, y: str, parts: int = 64) -> DataFrame:
    """Points that no other beats on both axes (at least as good on both, better on one); larger is better.

    One row per x after aggregation; a running maximum of y over larger x decides, inside
    each of `parts` ranges of x, together with the best of the ranges to the right: no
    theta join, and no window over all rows.
    """
    best = points.groupBy(x).agg(F.max(y).alias("_best"))
    cuts = best.select(F.percentile_approx(x, [k / parts for k in range(1, parts)], 10_000).alias("c")).first()["c"]
    part = sum((F.when(F.col(x) > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    best = best.withColumn("_part", part)
    # At most `parts` rows: the best y of all parts to the right of each.
    tops = best.groupBy("_part").agg(F.max("_best").alias("_top"))
    right = tops.select("_part", F.max("_top").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_right"))
    above = Window.partitionBy("_part").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    edge = best.withColumn("_inside", F.max("_best").over(above)).join(F.broadcast(right), "_part")
    over = F.greatest("_inside", "_right")
    edge = edge.filter(over.isNull() | (F.col("_best") > over))
    edge = edge.select(F.col(x).alias("_x"), "_best")
    return points.join(edge, (points[x] == edge["_x"]) & (points[y] == edge["_best"]), "left_semi")


def versus(meas: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (label, ours, theirs) against first measurements by (name, input): both rates and their quotient."""
    rows = first_rows(meas, ["name", "input"]).select("name", "input", "gbps")
    a = rows.select(F.col("name").alias("ours"), "input", F.col("gbps").alias("our_gbps"))
    b = rows.select(F.col("name").alias("theirs"), "input", F.col("gbps").alias("their_gbps"))
    return pairs.join(a, "ours").join(b, ["theirs", "input"]).withColumn("quotient", F.col("our_gbps") / F.col("their_gbps"))


def with_kernel(meas: DataFrame) -> DataFrame:
    """End-to-end rows with the kernel row of the same stem and input, if any."""
    rows = first_rows(meas, ["name", "input"])
    kernel = rows.filter(F.col("name").endswith(".kernel")).select(F.regexp_replace("name", r"\.kernel$", ".e2e").alias("name"), "input", F.col("gbps").alias("kernel_gbps"))
    return rows.filter(F.col("name").endswith(".e2e")).join(kernel, ["name", "input"], "left")


def stage_times(prefixes: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """Time of each stage from the times up to it: differences, never below 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return prefixes.withColumn("stage_ms", F.greatest(F.col(time) - F.coalesce(F.lag(time).over(w), F.lit(0.0)), F.lit(0.0)))


def headline(meas: DataFrame) -> DataFrame:
    """Per adapter the input that tables describe: a concatenation, else 'text', else the first measured."""
    rank = F.when(F.col("input").endswith("/all"), 0).when(F.col("input") == "text", 1).otherwise(2)
    return meas.groupBy("adapter").agg(F.min_by("input", F.struct(rank, F.col("ord"))).alias("headline"))


def first_seen(meas: DataFrame, column: str) -> DataFrame:
    return meas.groupBy(column).agg(F.min("ord").alias("seen")).orderBy("seen")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table; missing cells show a dash."""
    show = lambda v: "—" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows])


def fill_template(template: str, sections: dict[str, str]) -> str:
    """Replace each {{name}}; an empty section says so, an unknown one is an error."""
    import re

    def text(m: re.Match) -> str:
        if m[1] not in SECTIONS and m[1] not in sections:
            raise ValueError(f"no section {m[1]!r}; known: {', '.join(SECTIONS)}")
        return sections.get(m[1], "(no measurements)")

    return re.sub(r"\{\{\s*([a-z-]+)\s*\}\}", text, template)
