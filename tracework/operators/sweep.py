"""State metrics: time-weighted distances between the multisets of active instances of two logs.

No multiset is ever built. An instance gives +1 at its start and -1 at its end; running sums per key give both logs' counts,
and differences of min, max, |a - b| and a + b per key, summed over keys and run along time, give every distance's numerator and
denominator at every boundary. Intervals are half open; equal instances count separately; zero-length ones are left out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.functions.scalar import SECOND, micros
from tracework.operators.areas import SCHEMA, measuring
from tracework.operators.running import MOST_RANGES, ROWS_A_RANGE, range_of, running
from tracework.sources.scratch import stored

#: View name to the key of an instance.
VIEWS = {
    "activity_case": lambda: _key("activity", "case_id"),
    "case": lambda: _key("case_id"),
    "activity": lambda: _key("activity"),
    "activity_role": lambda: _key("activity", "role"),
    "case_type": lambda: _key("case_type"),
    "activity_type": lambda: _key("activity", "case_type"),
}
DISTANCES = ("jaccard", "cardinality")
#: The columns of a view's key.
_PARTS = {"activity_case": ("activity", "case_id"), "case": ("case_id",), "activity": ("activity",), "activity_role": ("activity", "role"), "case_type": ("case_type",), "activity_type": ("activity", "case_type")}
#: A task sweeps about so many boundaries, all views counted, and up to 2 ** MOST_HALVINGS as many where instances are long.
EDGES_A_RANGE, MOST_HALVINGS = 1_000_000, 3
#: A task measures areas over about so many instances, and never over more than MOST_PIECES times as many, those that only reach into its range included.
INSTANCES_A_RANGE, MOST_PIECES = 500_000, 6
#: Most tasks over which the groups of one range are dealt.
MOST_DEALS = 256


def _key(*columns: str) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def views_for(*logs: DataFrame, roles: DataFrame | None = None) -> list[str]:
    """The views that the logs' columns allow: types where any log has them, roles where a map is given."""
    typed = any("case_type" in x.columns for x in logs)
    return [v for v in VIEWS if (v != "activity_role" or roles is not None) and (not v.endswith("type") or typed)]


def with_role(log: DataFrame, roles: DataFrame, missing: str = "error") -> DataFrame:
    """Look roles up by resource. missing: `null`, `unknown` (that word) or `error`."""
    out = log.join(roles, "resource", "left")
    if missing == "error":
        return out.withColumn("role", F.when(F.col("role").isNotNull(), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("no role for resource "), F.coalesce("resource", F.lit("null"))))))
    return out.withColumn("role", F.coalesce("role", F.lit("unknown"))) if missing == "unknown" else out


def spans(a: DataFrame, b: DataFrame, views: list[str], roles: DataFrame | None = None, missing_role: str = "error", group: str | None = None) -> tuple[DataFrame, Column]:
    """Every instance of positive length with s, t and side, one row an instance, and its (view, key) under every view, an array to be.

    missing_role as with_role() takes it. With a column of both logs as group, its value and a colon stand before the view's name: each
    group is compared on its own.
    """
    name = lambda v: F.concat(F.col(group), F.lit(f":{v}")) if group else F.lit(v)
    keys = F.array(*[F.struct(name(v).alias("view"), VIEWS[v]().alias("key")) for v in views])
    used = [c for c in ("activity", "case_id", "role", "case_type") if any(c in _PARTS[v] for v in views)]

    def one(log: DataFrame, side: int) -> DataFrame:
        log = log.filter("end_time > start_time")
        for c in ("case_type", "resource"):
            if c not in log.columns:
                log = log.withColumn(c, F.lit(None).cast("string"))
        if "activity_role" in views:
            log = with_role(log, roles, missing_role)
        return log.select(*([group] if group else []), *used, micros("start_time").alias("s"), micros("end_time").alias("t"), F.lit(side).alias("side"))

    return one(a, 0).unionByName(one(b, 1)), keys


def exploded(rows: DataFrame, keys: Column) -> DataFrame:
    """(view, key, s, t, side) of instances and their keys."""
    return rows.select(F.explode(keys).alias("v"), "s", "t", "side").select("v.view", "v.key", "s", "t", "side")


def instances(a: DataFrame, b: DataFrame, views: list[str], roles: DataFrame | None = None, missing_role: str = "error", group: str | None = None) -> DataFrame:
    """(view, key, s, t, side): every instance of positive length under every view, as spans() has them."""
    return exploded(*spans(a, b, views, roles, missing_role, group))


def keyed_steps(found: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(view, k1, k2, at, da, db, run_da, run_db, next_at): how many instances of a key each log has from a boundary of the key on.

    A key travels as 128 bits of hash; key_names() has its parts.
    """
    return _keyed_steps(found, rows_a_range)[0]


def _keyed_steps(found: DataFrame, rows_a_range: int) -> tuple[DataFrame, int]:
    """keyed_steps() and the most rows that a view has, which bounds the rows of a key and of a view's boundaries."""
    sides = [F.when(F.col("side") == k, F.col("d")).otherwise(0) for k in (0, 1)]
    both = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("t").alias("at"), F.lit(-1).alias("d")))
    edges = found.select("view", *_hashes(), "side", F.explode(both).alias("e")).select("view", "k1", "k2", "side", "e.at", "e.d")
    deltas = edges.groupBy("view", "k1", "k2", "at").agg(F.sum(sides[0]).alias("da"), F.sum(sides[1]).alias("db"))
    deltas = stored(deltas)
    most = deltas.groupBy("view").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return running(deltas, ["view", "k1", "k2"], "at", ["da", "db"], rows_a_range, kept=True, most=most), most


def _hashes() -> list[Column]:
    return [F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("~"), "key").alias("k2")]


def key_names(found: DataFrame) -> DataFrame:
    """(view, k1, k2, key): the parts of each key, a row a key."""
    return found.select("view", *_hashes(), "key").groupBy("view", "k1", "k2").agg(F.first("key").alias("key"))


def steps(keyed: DataFrame, rows_a_range: int = ROWS_A_RANGE, most: int | None = None) -> DataFrame:
    """(view, t, next_t, low, high, apart, total) at every boundary: sums over keys of min, max, |a - b| and a + b."""
    a, b, pa, pb = F.col("run_da"), F.col("run_db"), F.col("run_da") - F.col("da"), F.col("run_db") - F.col("db")
    change = keyed.groupBy("view", "at").agg(
        F.sum(F.least(a, b) - F.least(pa, pb)).alias("low"),
        F.sum(F.greatest(a, b) - F.greatest(pa, pb)).alias("high"),
        F.sum(F.abs(a - b) - F.abs(pa - pb)).alias("apart"),
        F.sum(a + b - pa - pb).alias("total"),
        F.sum("da").alias("a"),
        F.sum("db").alias("b"),
    )
    sums = ["low", "high", "apart", "total", "a", "b"]
    out = running(change, ["view"], "at", sums, rows_a_range, most=most)
    return out.select("view", F.col("at").alias("t"), F.col("next_at").alias("next_t"), *[F.col(f"run_{c}").alias(c) for c in sums])


class Sweep:
    """One sweep of some instances for all that reads it. The instances are written once, a row an instance, not a row a view.

    Time is cut into ranges of about equally many boundaries. An instance goes to each range that it touches, clipped to it, so that a
    range is swept on its own, all views and keys of it in one task: one exchange of instances, none of boundaries. Ranges are made
    twice as long until no more pieces are added than there are instances. Where even the longest would do so (most instances overlap
    most others), boundaries are dealt by their keys instead, and written (`keyed`, and `steps` of each view).

    found: (view, key, s, t, side), or instances with their keys as spans() has them. group: a column of theirs whose values share no view (the
    steps of a ladder): a range of time is dealt over tasks by it, so that ranges need not be short where steps are many.
    views: name to the parts of its key and the kinds of rows (column kind) it counts; areas() needs them.
    """

    def __init__(self, found: DataFrame, rows_a_range: int | None = None, keys: Column | None = None, group: str | None = None, views: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] | None = None):
        self.group = group
        self.keys = F.array(F.struct("view", "key")) if keys is None else keys
        self.views = views
        self.rows = stored(found)
        self.wanted = rows_a_range
        self.rows_a_range = rows_a_range or ROWS_A_RANGE

    @cached_property
    def cut(self) -> list | None:
        """Bounds of the ranges (numbers on the driver), or None where there would be too many pieces."""
        edges_a_range = self.wanted or EDGES_A_RANGE
        groups = F.count_distinct(self.group) if self.group else F.lit(1)
        got = self.rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(self.keys)).alias("keys"), groups.alias("groups")).first()
        self.deals = max(1, min(got["groups"], MOST_DEALS))
        k = min(MOST_RANGES, -(-2 * (got["keys"] or 0) // (edges_a_range * self.deals)))
        if k <= 1:
            return []
        found = self.rows.agg(F.percentile_approx("s", [i / k for i in range(1, k)], 10 * k).alias("b")).first()["b"]
        found = sorted(set(found))
        at = {c: range_of(F.col(c), found) for c in "st"}
        twice = lambda c, j: F.shiftright(at[c], j)
        more = self.rows.agg(*[F.sum(twice("t", j) - twice("s", j)).alias(str(j)) for j in range(MOST_HALVINGS + 1)]).first()
        return next((found[(1 << j) - 1 :: 1 << j] for j in range(MOST_HALVINGS + 1) if more[j] <= got["n"]), None)

    @cached_property
    def wide(self) -> list | None:
        """cut for areas(): a view of a range is measured at a time, so that ranges are as long as instances are many, not their keys. None also where
        a range would have too many pieces for a task's memory, as where very many instances begin at once."""
        size = self.wanted or INSTANCES_A_RANGE
        n = self.rows.count()
        k = min(MOST_RANGES, -(-n // size))
        found = sorted(set(self.rows.agg(F.percentile_approx("s", [i / k for i in range(1, k)], 10 * k).alias("b")).first()["b"] or [])) if k > 1 else []
        ends = F.array(*[F.struct(F.lit(c).alias("c"), range_of(F.col(c), found).alias("r")) for c in "st"])
        count = {(r["c"], r["r"]): r["n"] for r in self.rows.select(F.explode(ends).alias("e")).groupBy("e.c", "e.r").agg(F.count(F.lit(1)).alias("n")).collect()}
        for j in range(MOST_HALVINGS + 1):
            open_now = most = added = 0
            for r in range((len(found) >> j) + 1):
                inside = range(r << j, (r + 1) << j)
                pieces = open_now + sum(count.get(("s", i), 0) for i in inside)
                added, most = added + open_now, max(most, pieces)
                open_now = pieces - sum(count.get(("t", i), 0) for i in inside)
            if added <= n and most <= MOST_PIECES * size:
                return found[(1 << j) - 1 :: 1 << j]
        return None

    def _part(self, number: Column) -> Column:
        """The task's number of a range of time and the row's group."""
        return (number * self.deals + F.pmod(F.xxhash64(self.group), F.lit(self.deals)).cast("int")) if self.deals > 1 else number

    @cached_property
    def found(self) -> DataFrame:
        """(view, key, s, t, side)."""
        return exploded(self.rows, self.keys)

    @cached_property
    def _keyed(self) -> tuple[DataFrame, int]:
        keyed, most = _keyed_steps(self.found, self.rows_a_range)
        return stored(keyed), most

    @property
    def keyed(self) -> DataFrame:
        """keyed_steps(), written."""
        return self._keyed[0]

    @property
    def most(self) -> int:
        return self._keyed[1]

    @property
    def steps(self) -> DataFrame:
        """(view, t, next_t, low, high, apart, total, a, b) at every boundary."""
        return self.ranged_steps.drop("_range")

    @cached_property
    def ranged_steps(self) -> DataFrame:
        """steps with the number of their range."""
        if self.cut is None:
            return stored(steps(self.keyed, self.rows_a_range, self.most).withColumn("_range", F.lit(0)))
        w = Window.partitionBy("view", "_range").orderBy("t", "real")
        real = self.swept.filter("real = 1").withColumn("next_t", F.lead("t").over(w))
        if self.cut:  # the first boundary after a range: a row a view and range
            both = F.array(*[F.struct(F.col(c).alias("at"), self._part(range_of(F.col(c), self.cut)).alias("_range")) for c in "st"])
            first = self.rows.withColumn("e", both).withColumn("v", F.explode(self.keys)).select("v.view", F.explode("e").alias("e")).groupBy("view", "e._range").agg(F.min("e.at").alias("first"))
            later = first.select("view", "_range", F.lead("first").over(Window.partitionBy("view").orderBy("_range")).alias("_later"))
            real = real.join(F.broadcast(stored(later)), ["view", "_range"]).withColumn("next_t", F.coalesce("next_t", "_later"))
        return real.select("view", "t", "next_t", "low", "high", "apart", "total", "a", "b", "_range")

    @property
    def stretches(self) -> DataFrame:
        """steps whose sums over time are right, but not the rows: ranges have a boundary of their own where they begin and end, and next_t is null at
        the end of each. Cheaper than steps."""
        return self.ranged_steps if self.cut is None else self.swept

    def areas(self, names: bool) -> DataFrame:
        """areas.SCHEMA: of each view and range, and, with names, of each key of them, written, as it is read more than once; wide must not be None."""
        return self._named_areas if names or "_named_areas" in self.__dict__ else self._areas(False)

    @cached_property
    def _named_areas(self) -> DataFrame:
        return stored(self._areas(True))

    def _areas(self, names: bool) -> DataFrame:
        lo, hi = (F.get(F.lit(self.wide), F.col("_range") - d) if self.wide else F.lit(None).cast(dict(self.rows.dtypes)["s"]) for d in (1, 0))
        pieces = self.rows.withColumns({f"_{c}": range_of(F.col(c), self.wide) for c in "st"}).withColumn("_range", F.explode(F.sequence("_s", "_t")))
        clipped = {"s": F.when(F.col("_s") == F.col("_range"), F.col("s")).otherwise(lo), "t": F.when(F.col("_t") == F.col("_range"), F.col("t")).otherwise(hi)}
        parts = sorted({c for of, _ in self.views.values() for c in of})
        pieces = pieces.select("_range", "kind", "side", *[v.alias(k) for k, v in clipped.items()], *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in parts]).filter("t > s")
        return pieces.repartitionById(len(self.wide) + 1, F.col("_range")).mapInArrow(measuring(self.views, names), SCHEMA)

    @property
    def changes(self) -> DataFrame:
        """(_range, view, k1, k2, at, real, da, db, run_da, run_db, next_at): boundaries of each key's pieces, equal times in any order."""
        lo, hi = (F.get(F.lit(self.cut), F.col("_at") - d) if self.cut else F.lit(None) for d in (1, 0))
        pieces = self.rows.withColumns({f"_{c}": range_of(F.col(c), self.cut) for c in "st"})
        pieces = pieces.withColumn("_at", F.explode(F.sequence("_s", "_t"))).withColumn("_range", self._part(F.col("_at")))
        if (n := (len(self.cut) + 1) * self.deals) > 1:
            pieces = pieces.repartitionById(n, F.col("_range"))
        begins, ends = F.col("_s") == F.col("_at"), F.col("_t") == F.col("_at")
        own = {"a0": F.when(begins, F.col("s")).otherwise(lo) if self.cut else F.col("s"), "a1": F.when(ends, F.col("t")).otherwise(hi) if self.cut else F.col("t"), "r0": begins, "r1": ends}
        edges = pieces.withColumns(own).withColumn("v", F.explode(self.keys)).select("_range", "v.view", F.col("v.key").alias("key"), "side", *own)
        edges = edges.select("_range", "view", *_hashes(), "side", *own, F.explode(F.array(F.lit(1), F.lit(-1))).alias("d"))
        first = F.col("d") == 1
        sides = [F.when(F.col("side") == k, F.col("d")).otherwise(F.lit(0)).alias(c) for k, c in enumerate(("da", "db"))]
        edges = edges.select("_range", "view", "k1", "k2", F.when(first, F.col("a0")).otherwise(F.col("a1")).alias("at"), F.when(first, F.col("r0")).otherwise(F.col("r1")).cast("int").alias("real"), *sides)
        w = Window.partitionBy("k1", "k2", "view", "_range").orderBy("at")
        rows = w.rowsBetween(Window.unboundedPreceding, 0)
        return edges.withColumns({"run_da": F.sum("da").over(rows), "run_db": F.sum("db").over(rows), "next_at": F.lead("at").over(w)})

    @property
    def swept(self) -> DataFrame:
        """(view, _range, t, next_t, real, low, high, apart, total, a, b): the state at each boundary of a range, its own ones (real = 0) included."""
        return self.placed.filter("next_t IS NULL OR next_t > t").select("view", "_range", "t", "next_t", "real", "low", (F.col("total") - F.col("low")).alias("high"), (F.col("total") - 2 * F.col("low")).alias("apart"), "total", "a", "b")

    @property
    def placed(self) -> DataFrame:
        """Rows of changes along the time of their view, with the sums by then; of rows of one time the last has the state."""
        a, b, pa, pb = F.col("run_da"), F.col("run_db"), F.col("run_da") - F.col("da"), F.col("run_db") - F.col("db")
        each = self.changes.select("_range", "view", "k1", "k2", F.col("at").alias("t"), "real", "da", "db", (F.least(a, b) - F.least(pa, pb)).alias("low"), F.col("next_at"), (F.abs(a - b) - F.abs(pa - pb)).alias("apart_by"), ((a != b) & (F.col("next_at") > F.col("at"))).alias("differs"))
        w = Window.partitionBy("view", "_range").orderBy("t", "real")
        rows = w.rowsBetween(Window.unboundedPreceding, 0)
        sums = {"a": F.sum("da").over(rows), "b": F.sum("db").over(rows), "low": F.sum("low").over(rows), "next_t": F.lead("t").over(w)}
        return each.select("_range", "view", "k1", "k2", "t", "real", "apart_by", "differs", *[v.alias(k) for k, v in sums.items()]).withColumn("total", F.col("a") + F.col("b"))


def timeline(found: DataFrame | Sweep, whole: bool = True) -> DataFrame:
    """(view, distance, t, next_t, d): each distance at each boundary. Not whole: what summary() needs, which is cheaper."""
    sweep = found if isinstance(found, Sweep) else Sweep(found)
    s = sweep.steps if whole else sweep.stretches
    jaccard = F.when(F.col("high") > 0, 1 - F.col("low") / F.col("high")).otherwise(0.0)
    most = F.greatest("a", "b")
    cardinality = F.when(most > 0, F.abs(F.col("a") - F.col("b")) / most).otherwise(0.0)
    both = F.array(F.struct(F.lit("jaccard").alias("distance"), jaccard.alias("d")), F.struct(F.lit("cardinality").alias("distance"), cardinality.alias("d")))
    return s.select("view", "t", "next_t", F.explode(both).alias("x")).select("view", "x.distance", "t", "next_t", "x.d")


def summary(line: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """(view, distance, summary_distance, total_duration_seconds): weighted by time over the observed span, or over a window's length."""
    if window is not None and window[1] <= window[0]:
        raise ValueError("a window must end after it starts")
    weight = F.coalesce(F.col("next_t") - F.col("t"), F.lit(0))
    out = line.groupBy("view", "distance").agg(F.sum(F.col("d") * weight).alias("area"), (F.max("t") - F.min("t")).alias("span"))
    length = F.lit(window[1] - window[0]) if window is not None else F.col("span")
    return out.select("view", "distance", F.when(length > 0, F.col("area") / length).otherwise(0.0).alias("summary_distance"), (length / SECOND).alias("total_duration_seconds"))


def state_distances(a: DataFrame, b: DataFrame, views: list[str] | None = None, roles: DataFrame | None = None, window: tuple[int, int] | None = None, missing_role: str = "error") -> DataFrame:
    """All views and distances of two logs in one pass."""
    views = views or views_for(a, b, roles=roles)
    rows, keys = spans(a, b, views, roles, missing_role)
    return summary(timeline(Sweep(rows, keys=keys), whole=False), window)
