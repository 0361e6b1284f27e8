"""Rule tables: exact, array, default, longest-prefix and access-control lookups, and pipelines of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules compiled into one expression; more are compiled into several, one after another.
RULES = 1024


def exact_lookup(rows: DataFrame, rules: DataFrame, keys: list[str], default: dict[str, object] | None = None) -> DataFrame:
    """rows with the columns of the rule of equal keys, and hit. Misses get the default entry.

    Spark broadcasts the rules where their size allows it, else it shuffles both sides.
    """
    entry = [c for c in rules.columns if c not in keys]
    found = rows.join(rules.withColumn("hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    for name in entry:
        if default and name in default:
            found = found.withColumn(name, F.when(F.col("hit"), F.col(name)).otherwise(F.lit(default[name])))
    return found


def array_lookup(rows: DataFrame, entries: DataFrame, key: Column, size: int) -> DataFrame:
    """rows with the entry (index, ...) at key & (size - 1); always hits where all indices have one."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    return rows.withColumn("index", key.cast("long").bitwiseAND(F.lit(size - 1))).join(entries, "index", "left")


def default_action(rows: DataFrame, **entry: object) -> DataFrame:
    """The table that always misses: every row gets the default entry."""
    return rows.withColumns({k: F.lit(v) for k, v in entry.items()} | {"hit": F.lit(False)})


def _longest(rows: DataFrame, rules: DataFrame, value: str, prefix_of, bound: int) -> DataFrame:
    depths = sorted((r[0] for r in rules.select("depth").distinct().limit(bound + 1).collect()), reverse=True)
    if any(not 1 <= d <= bound for d in depths):
        raise ValueError(f"depths must lie in 1..{bound}")
    keep = rows.columns
    found = rows.withColumns({"next_hop": F.lit(None).cast(rules.schema["next_hop"].dataType), "depth": F.lit(None).cast("int")})
    for d in depths:
        at = rules.filter(F.col("depth") == d).select(prefix_of(F.col("prefix"), d).alias("_p"), F.col("next_hop").alias("_hop"))
        at = at.groupBy("_p").agg(F.max("_hop").alias("_hop"))
        found = found.withColumn("_p", prefix_of(F.col(value), d)).join(at, "_p", "left")
        better = F.col("depth").isNull() & F.col("_hop").isNotNull()
        found = found.select(*keep, F.coalesce("next_hop", "_hop").alias("next_hop"), F.when(better, d).otherwise(F.col("depth")).alias("depth"))
    return found


def lpm_lookup(rows: DataFrame, rules: DataFrame, ip: str) -> DataFrame:
    """rows with next_hop and depth of the longest matching prefix (null: a miss).

    rules: prefix (32-bit number), depth 1..32, next_hop. One equi-join for
    each depth in use, at most 32, longest first.
    """
    return _longest(rows, rules, ip, lambda x, d: F.shiftright(x.cast("long"), 32 - d), 32)


def lpm6_lookup(rows: DataFrame, rules: DataFrame, bits: str) -> DataFrame:
    """The same for 128-bit addresses, given as strings of 0 and 1; depth 1..128."""
    return _longest(rows, rules, bits, lambda x, d: F.substring(x, 1, d), 128)


@dataclass
class AclRule:
    """fields: column to ("mask", value, bits), ("range", low, high) or ("bitmask", value, mask); fields not named match all."""

    fields: dict[str, tuple]
    priority: int
    userdata: int
    categories: tuple[int, ...] = (0,)

    def matches(self, width: int = 32) -> Column:
        test = F.lit(True)
        for name, (kind, a, b) in self.fields.items():
            x = F.col(name).cast("long")
            if kind == "mask":
                test = test & (F.shiftright(x, width - b) == (a >> (width - b)))
            elif kind == "range":
                test = test & x.between(a, b)
            else:
                test = test & (x.bitwiseAND(F.lit(b)) == (a & b))
        return test


def acl_classify(rows: DataFrame, rules: list[AclRule], categories: int = 1) -> DataFrame:
    """rows with class_0 .. class_{n-1}: userdata of the matching rule of highest priority, 0 without one.

    The rules are compiled into expressions, so the rows stay where they are
    and no rule table is shuffled; each expression's best rule is held against
    the best so far. Ties of priority go to the rule that stands first.
    """
    names = [free_name(rows.columns, f"best_{c}") for c in range(categories)]
    none = F.lit(None).cast("struct<p:int,i:int,u:int>")
    out = rows.withColumns({name: none for name in names})
    for start in range(0, len(rules), RULES):
        best = {}
        for c, name in enumerate(names):
            hits = [
                F.when(r.matches(), F.struct(F.lit(r.priority).cast("int").alias("p"), F.lit(-i).cast("int").alias("i"), F.lit(r.userdata).cast("int").alias("u")))
                for i, r in enumerate(rules[start : start + RULES], start)
                if c in r.categories
            ]
            if hits:
                best[name] = F.array_max(F.array_compact(F.array(F.col(name), *hits)))
        out = out.withColumns(best)
    classes = {f"class_{c}": F.coalesce(F.col(name)["u"], F.lit(0)) for c, name in enumerate(names)}
    return out.withColumns(classes).drop(*names)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores before it until it is none of the columns."""
    while name in columns:
        name = f"_{name}"
    return name


def add_rules(rules: DataFrame, keys: list[str], more: DataFrame) -> DataFrame:
    """rules with those of more; an entry of the same keys is replaced."""
    return rules.join(more.select(*keys).distinct(), keys, "left_anti").unionByName(more)


def delete_rules(rules: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """rules without the keys that stand in gone."""
    return rules.join(gone.select(*keys).distinct(), keys, "left_anti")


@dataclass
class Stage:
    """A table of a pipeline: look adds action (DROP, PORT, TABLE) and target columns to rows."""

    name: str
    look: object
    stats: list = field(default_factory=list)


def firewall(rules: list[AclRule]):
    """A stage's look: packets whose best rule has userdata 1 pass to the table named by `then`, all others are dropped."""

    def make(then: str):
        def look(rows: DataFrame) -> DataFrame:
            allowed = acl_classify(rows, rules)
            return allowed.withColumns({"action": F.when(F.col("class_0") == 1, "TABLE").otherwise("DROP"), "target": F.lit(then)}).drop("class_0")

        return look

    return make


def flow_classifier(entries: DataFrame, keys: list[str], missed: int):
    """A stage's look: packets go out at their flow's port (column port of entries), misses at the default one."""

    def look(rows: DataFrame) -> DataFrame:
        found = rows.join(entries.select(*keys, F.col("port").alias("_port")), keys, "left")
        return found.withColumns({"action": F.lit("PORT"), "target": F.coalesce("_port", F.lit(missed)).cast("string")}).drop("_port").select(*rows.columns, "action", "target")

    return look


def router(routes: DataFrame, ip: str, arp: DataFrame | None = None):
    """A stage's look: the longest prefix gives the port; without one, or without the next hop's address in arp, a packet is dropped."""

    def look(rows: DataFrame) -> DataFrame:
        found = lpm_lookup(rows, routes, ip)
        known = F.col("next_hop").isNotNull()
        if arp is not None:
            found = found.join(arp.select(F.col("next_hop"), F.lit(True).alias("_known")).distinct(), "next_hop", "left")
            known = known & F.coalesce("_known", F.lit(False))
        out = found.withColumns({"action": F.when(known, "PORT").otherwise("DROP"), "target": F.col("next_hop").cast("string")})
        return out.select(*rows.columns, "action", "target")

    return look


def passthrough(port: int):
    """A stage's look: every packet goes out at one port."""
    return lambda rows: rows.withColumns({"action": F.lit("PORT"), "target": F.lit(str(port))})


def pipeline_route(rows: DataFrame, stages: list[Stage]) -> DataFrame:
    """rows with port (null: dropped) and table, the one that decided; stages are run in order.

    A stage's TABLE action passes a row to the stage named by target, which
    must come later; PORT sends it out, DROP ends it.
    """
    out, waiting = None, rows.withColumn("_at", F.lit(stages[0].name))
    keep = rows.columns
    for i, stage in enumerate(stages):
        done = stage.look(waiting.filter(F.col("_at") == stage.name).select(*keep))
        left = F.col("action") != "TABLE"
        port = F.when(F.col("action") == "PORT", F.col("target").cast("int"))
        ended = done.filter(left).select(*keep, port.alias("port"), F.lit(stage.name).alias("table"))
        out = ended if out is None else out.unionByName(ended)
        passed = done.filter(~left).select(*keep, F.col("target").alias("_at"))
        waiting = waiting.filter(F.col("_at") != stage.name).unionByName(passed)
    return out


def table_stats(looked: DataFrame) -> DataFrame:
    """packets, hits, misses of a lookup's result."""
    return looked.agg(F.count(F.lit(1)).alias("packets"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
