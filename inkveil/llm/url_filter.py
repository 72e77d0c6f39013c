"""URL filter by path-template trees, in SQL functions only.

Each URL's path is a chain of segments under its host. Segments that vary by their looks (numbers, hexadecimal ids,
UUIDs) become wildcards first, which leaves few distinct templates a host; everything after is done on those, with the
counts of their URLs, never on the rows of a host. Level by level, from the root:

* under a node with many children, those with little support become one wildcard child;
* children with fewer than LABELLED labelled URLs tell too little by themselves and become one branch;
* the others merge in the order of their shares of bad URLs: the next child joins the merged branch so far unless its share
  differs significantly (two-proportion z of Z or more) from the pooled share of that branch or from that of its first
  member, or lies on the other side of REJECT. So a chain of small differences doesn't tie unlike branches together.

Children of a node with equal counts are one class, so a node is a list of distinct counts (far fewer than its children) and
of the starts of its branches; no window or list spans the children themselves.

A template is rejected if the smoothed share of bad ones among its labelled URLs, shrunk to its host's share and that to
the share of all, reaches one half. Explicit rules (host, path) come before: a rule fits its host and all subdomains if
the URL's path starts with the rule's, and the longest one wins.

Templates have DEPTH levels, and one more for all that follows, joined, with its own wildcards, however long. Defined
results: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged like any template (that of
the empty host); an empty table gives no rows; without labels nothing is rejected; repeated rows count each time and keep a
row each; repeated labels of a key count once, as bad if any is; children of equal shares are taken in the order of
their counts, so ties don't depend on the order of rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.llm.common import ascii_lower, stored

#: Levels of a template; children from which a node's weak ones become a wildcard; URLs below which a child is weak;
#: labelled URLs below which a child isn't compared by itself.
DEPTH, WIDE, WEAK, LABELLED = 8, 16, 8, 4
#: Siblings merge below this z; pseudo-counts of the parent's share; share of bad URLs from which a template is rejected.
Z, SHRINK, REJECT = 1.64, 4.0, 0.5
#: Templates up to which the verdicts are broadcast (a row of some hundred bytes each); beyond it, joined by shuffle.
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def template_of(path: Column) -> Column:
    """The path's segments with wildcards for those that vary by their looks; those beyond DEPTH are joined into one."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: (
        F.when(x.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), F.regexp_replace(x, r"^[0-9]+", "{n}"))
        .when(x.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), F.lit("{u}"))
        .when(x.rlike(r"^(?=.*[0-9])[0-9a-fA-F]{8,}$"), F.lit("{h}"))
        .otherwise(F.regexp_replace(x, r"[0-9]+", "{n}"))
    )
    return F.when(F.size(segments) > DEPTH, F.concat(F.transform(F.slice(segments, 1, DEPTH), shape), F.array(F.array_join(F.transform(F.slice(segments, DEPTH + 1, F.size(segments)), shape), "/")))).otherwise(F.transform(segments, shape))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) by (verdict, host, path) rules, the longest first; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(at + prefix)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def differ(lab: Column, bad: Column, plab: Column, pbad: Column) -> Column:
    """Whether two smoothed shares of bad ones differ significantly, or lie on the two sides of REJECT."""
    one, two = (bad + 0.5) / (lab + 1), (pbad + 0.5) / (plab + 1)
    pooled = (bad + pbad + 1) / (lab + plab + 2)
    z = F.abs(one - two) / F.sqrt(pooled * (1 - pooled) * (1 / (lab + 1) + 1 / (plab + 1)))
    return (z >= Z) | ((bad >= REJECT * lab) != (pbad >= REJECT * plab))


def branch_starts(classes: Column) -> Column:
    """Of sorted distinct struct<rate, lab, bad, m> (m children of these counts): the classes that begin a branch."""
    first = lambda x: F.struct((x["m"] * x["lab"]).alias("lab"), (x["m"] * x["bad"]).alias("bad"), x["lab"].alias("flab"), x["bad"].alias("fbad"))

    def step(acc: Column, x: Column) -> Column:
        apart = acc["now"].isNull() | differ(x["lab"], x["bad"], acc["now"]["lab"], acc["now"]["bad"]) | differ(x["lab"], x["bad"], acc["now"]["flab"], acc["now"]["fbad"])
        more = F.struct((acc["now"]["lab"] + x["m"] * x["lab"]).alias("lab"), (acc["now"]["bad"] + x["m"] * x["bad"]).alias("bad"), acc["now"]["flab"].alias("flab"), acc["now"]["fbad"].alias("fbad"))
        here = F.array(F.struct(x["rate"].alias("rate"), x["lab"].alias("lab"), x["bad"].alias("bad")))
        return F.struct(F.when(apart, first(x)).otherwise(more).alias("now"), F.when(apart, F.concat(acc["starts"], here)).otherwise(acc["starts"]).alias("starts"))

    none = F.struct(F.lit(None).cast("struct<lab:bigint,bad:bigint,flab:bigint,fbad:bigint>").alias("now"), F.array().cast("array<struct<rate:double,lab:bigint,bad:bigint>>").alias("starts"))
    return F.aggregate(classes, none, step, lambda acc: acc["starts"])


def _small(df: DataFrame) -> DataFrame:
    """Broadcast while it has few rows; else joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def templates(rows: DataFrame) -> DataFrame:
    """(host, t0, template, n_labelled, n_bad, purity_bad) of each distinct (host, t0) of (host, t0 array, bad boolean or null)."""
    t = rows.groupBy("host", "t0").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.count_if("bad").alias("nbad"))
    # written tables, not checkpoints: these keep the sizes that joins are estimated to have, which grow without bound by level
    t = stored(t.withColumn("done", F.lit("")), "templates")
    deepest = t.agg(F.max(F.size("t0")).alias("d")).first()["d"] or 0
    node = ["host", "done"]
    for level in range(deepest):  # DEPTH + 1 at most
        live = t.where(F.size("t0") > level).withColumn("seg", F.get(F.col("t0"), F.lit(level)))
        child = live.groupBy(*node, "seg").agg(F.sum("n").alias("cn"), F.sum("lab").alias("clab"), F.sum("nbad").alias("cbad"))
        wide = child.groupBy(*node).agg(F.count("*").alias("wide")).where(F.col("wide") > WIDE)
        child = child.join(_small(stored(wide, "wide")), node, "left")
        child = stored(child.withColumn("as", F.when(F.col("wide").isNotNull() & (F.col("cn") < WEAK), F.lit("*")).otherwise(F.col("seg"))), "children")
        branch = child.groupBy(*node, "as").agg(F.sum("clab").alias("lab"), F.sum("cbad").alias("bad"))
        enough = F.col("lab") >= LABELLED
        classes = branch.where(enough).groupBy(*node, "lab", "bad").agg(F.count("*").alias("m"))
        classes = classes.select(*node, F.struct(((F.col("bad") + 0.5) / (F.col("lab") + 1)).alias("rate"), "lab", "bad", "m").alias("x"))
        starts = classes.groupBy(*node).agg(branch_starts(F.sort_array(F.collect_list("x"))).alias("starts"))
        here = F.struct(((F.col("bad") + 0.5) / (F.col("lab") + 1)).alias("rate"), "lab", "bad")
        island = F.when(enough, F.size(F.filter("starts", lambda x: x <= here))).otherwise(0)
        branch = stored(branch.join(_small(stored(starts, "starts")), node, "left").withColumn("island", island).drop("starts"), "branches")
        islands = branch.groupBy(*node, "island").agg(F.min("as").alias("first"), F.count("*").alias("in"))
        whole = islands.groupBy(*node).agg(F.sum("in").alias("of"))
        named = F.when(F.col("in") == F.col("of"), F.lit("*")).otherwise(F.concat("first", F.lit("~"), F.col("in").cast("string")))
        # branches of one child keep its name
        islands = islands.where(F.col("in") > 1).join(whole, node).select(*node, "island", named.alias("named"))
        names = branch.join(_small(stored(islands, "islands")), [*node, "island"], "left").select(*node, "as", F.coalesce("named", "as").alias("named"))
        names = child.join(names, [*node, "as"]).select(*node, "seg", "named")
        moved = live.join(names, [*node, "seg"]).select("host", "t0", "n", "lab", "nbad", F.concat("done", F.lit("/"), F.col("named")).alias("done"))
        t = stored(moved.unionByName(t.where(F.size("t0") <= level)), "templates")
    everything = t.agg(F.sum("lab").alias("l"), F.sum("nbad").alias("b")).first()
    overall = (everything["b"] or 0) / everything["l"] if everything["l"] else 0.0
    hosts = t.groupBy("host").agg(((F.sum("nbad") + SHRINK * overall) / (F.sum("lab") + SHRINK)).alias("host_bad"))
    pure = t.groupBy("host", "done").agg(F.sum("lab").alias("n_labelled"), F.sum("nbad").alias("n_bad")).join(hosts, "host")
    pure = pure.withColumn("purity_bad", (F.col("n_bad") + SHRINK * F.col("host_bad")) / (F.col("n_labelled") + SHRINK))
    return stored(t.select("host", "t0", "done").join(pure, ["host", "done"]).select("host", "t0", F.col("done").alias("template"), "n_labelled", "n_bad", "purity_bad"), "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, n_labelled, n_bad, purity_bad) of each page. labels: (key bigint, bad
    boolean) by the last number of the path, which names the document a page was made of."""
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("_id", "host", "path", template_of(F.col("path")).alias("t0"), F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)").alias("key"))
    once = labels.where("key is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    # pages without a number are not sent to the labels: their null keys would meet in one task
    known = rows.where("key is not null").join(once, "key", "left").select("host", "t0", "bad")
    found = templates(known.unionByName(rows.where("key is null").select("host", "t0", F.lit(None).cast("boolean").alias("bad"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(_small(found), ["host", "t0"])
    by_method = F.when(F.col("purity_bad") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "template", "n_labelled", "n_bad", "purity_bad")
