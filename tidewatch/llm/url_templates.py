"""URL filter: a path-template tree per host, judged by smoothed purity.

The path of a url becomes a path of template segments: digits turn into ``{n}``, and from the host down
each segment with too few labels to be judged alone becomes ``*``. Too few means that they could
not turn the verdict even if all of them were of one kind; neither siblings nor depth have a part in it. A node
whose labels are too few, or whose pages share one path, has no branches below. From the
leaves up, branches of a node whose share of bad labels does not differ
significantly from the node's own merge into ``*``. A template is rejected if its
smoothed purity (bad labels, with PRIOR more rows of the overall share) is above one
half. Written rules go before: of those that fit, the longest decides.

Everything is DataFrame operations. The tree is a table of (host, steps) nodes that grows by a
level a round, as long as a node has labels to tell its branches apart, so unlabelled depth costs nothing.
"""

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): a host, with all its subdomains, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rows of the overall share that every template's labels are smoothed with.
PRIOR = 10
DEVIATIONS = 3


def host_and_path(url: str = "url"):
    """Host (A-Z lower-cased) and path of a url, as two columns; both empty without ``://``."""
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    there = F.coalesce(F.locate("://", F.col(url)) > 0, F.lit(False))
    authority = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    blank = F.lit("")
    return (F.when(there, F.translate(authority, UPPER, LOWER)).otherwise(blank),
            F.when(there, path).otherwise(blank))


def rule_and_verdict(rules=RULES):
    """The longest fitting rule and its verdict, over columns host and path; null where none fits."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        mine = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = mine & F.col("path").startswith("/" + path)
        chosen, verdict = F.when(fits, rule).otherwise(chosen), F.when(fits, says).otherwise(verdict)
    return chosen, verdict


def with_shape(pages: DataFrame) -> DataFrame:
    """Add ``shape``: column path with typed segments, whole, without outer or repeated slashes."""
    typed = F.regexp_replace(F.regexp_replace("path", "[0-9]+", "{n}"), "/+", "/")
    return pages.withColumn("shape", F.regexp_replace(typed, "^/|/$", ""))


def least_labels(labelled: int, bad: int) -> int:
    """Labels from which on a template can be judged against the prior: all bad where that allows, all good where not."""
    return PRIOR * abs(labelled - 2 * bad) // labelled + 1


def grown(shapes: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Distinct shapes (host, shape, labelled, bad) with ``steps``, their leaf of the tree, and its number of levels."""
    rest = F.when(F.locate("/", F.col("_tail")) > 0, F.expr("substring(_tail, locate('/', _tail) + 1)")).otherwise("")
    node, done, level = ["host", "steps"], None, 0
    growing = shapes.withColumn("steps", F.array().cast("array<string>")).withColumn("_tail", F.col("shape"))
    while True:
        cut = growing.withColumn("_segment", F.substring_index("_tail", "/", 1))
        branches = cut.groupBy(*node, "_segment").agg(
            F.sum("labelled").alias("_n"), F.min("_tail").alias("_low"), F.max("_tail").alias("_high"))
        nodes = branches.groupBy(*node).agg(
            ((F.sum("_n") >= least) & (F.min("_low") != F.max("_high"))).alias("_grows"))
        named = branches.join(nodes, node).select(
            *node, "_segment", "_grows", F.when(F.col("_n") >= least, F.col("_segment")).otherwise("*").alias("_name"))
        # One row for each branch on the right, without a grouping on top: AQE may split a host of very many shapes.
        now = materialize(cut.join(named, [*node, "_segment"]).select(
            "host", "shape", "labelled", "bad",
            F.when(F.col("_grows"), F.concat("steps", F.array("_name"))).otherwise(F.col("steps")).alias("steps"),
            rest.alias("_tail"), "_grows"), "template-tree")
        leaf = now.where(~F.col("_grows")).drop("_tail", "_grows")
        done = leaf if done is None else done.unionByName(leaf)
        growing = now.where("_grows").drop("_grows")
        if growing.isEmpty():
            return done, level
        level += 1


def merged(leaves: DataFrame, level: int) -> DataFrame:
    """Leaves (host, steps, merged, labelled, bad) with the branches at ``level`` that differ from no sibling as ``*``.

    A branch differs if the square of its distance from the node's share of bad labels
    exceeds DEVIATIONS squared times the binomial variance. Leaves above the level stay.
    """
    above, name = F.slice("merged", 1, level - 1), F.get("merged", F.lit(level - 1))
    cut = leaves.withColumn("_above", above).withColumn("_name", name)
    branches = (cut.where(F.col("_name").isNotNull()).groupBy("host", "_above", "_name")
                .agg(F.sum("labelled").alias("_n"), F.sum("bad").alias("_b")))
    nodes = branches.groupBy("host", "_above").agg(F.sum("_n").alias("_nn"), F.sum("_b").alias("_bb"))
    number = {c: F.col(c).cast("double") for c in ("_n", "_b", "_nn", "_bb")}
    gap = number["_b"] * number["_nn"] - number["_bb"] * number["_n"]
    differs = gap * gap > DEVIATIONS**2 * number["_bb"] * (number["_nn"] - number["_bb"]) * number["_n"]
    same = branches.join(nodes, ["host", "_above"]).where(~differs).select("host", "_above", "_name", F.lit(True).alias("_same"))
    below = F.slice(F.col("merged"), F.lit(level + 1), F.size("merged"))
    return cut.join(same, ["host", "_above", "_name"], "left").select(
        "host", "steps", "labelled", "bad",
        F.when(F.col("_same"), F.concat("_above", F.array(F.lit("*")), below)).otherwise(F.col("merged")).alias("merged"))


def templates(shapes: DataFrame) -> DataFrame:
    """Distinct shapes (host, shape, labelled, bad) with template, template_labelled, template_bad, rejected."""
    labelled, bad = shapes.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    # Without labels no node reaches one label, and none grows.
    tree, depth = grown(shapes, least_labels(labelled, bad) if labelled else 1)
    leaves = materialize(tree.groupBy("host", "steps").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
                         .withColumn("merged", F.col("steps")), "template-leaves")
    for level in range(depth, 0, -1):
        leaves = materialize(merged(leaves, level), "template-level")
    sums = leaves.groupBy("host", "merged").agg(F.sum("labelled").alias("template_labelled"), F.sum("bad").alias("template_bad"))
    # Purity (bad + PRIOR * overall share) / (labelled + PRIOR) over one half, in whole numbers.
    judged = sums.withColumn("rejected", F.lit(labelled > 0) & (
        2 * (F.col("template_bad") * labelled + PRIOR * bad) > labelled * (F.col("template_labelled") + PRIOR)))
    name = F.concat(F.lit("/"), F.regexp_replace(F.array_join("merged", "/"), "/+$", ""))
    named = leaves.select("host", "steps", "merged").join(judged, ["host", "merged"]).withColumn("template", name)
    return tree.join(named, ["host", "steps"]).select(
        "host", "shape", "template", "template_labelled", "template_bad", "rejected")


def judge(pages: DataFrame, bad=None, rules=RULES, id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_labelled, template_bad of every row.

    ``bad`` is a boolean column of ``pages``, null where a page has no label; without labels the
    method allows everything. Null urls, and those without ``://``, have an empty host and path
    and share one template. Repeated rows are judged, and counted, each.
    """
    host, path = host_and_path(url)
    label = F.lit(None).cast("boolean") if bad is None else bad.cast("boolean")
    rows = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("_bad"))
    rows = materialize(with_shape(rows), "urls")
    shape = ["host", "shape"]
    shapes = materialize(rows.groupBy(*shape).agg(
        F.count("_bad").alias("labelled"), F.count_if("_bad").alias("bad")), "url-shapes")
    known = materialize(templates(shapes), "templates")
    rule, verdict = rule_and_verdict(rules)
    learned = F.when(F.col("rejected"), "block").otherwise("allow")
    # One row for each shape on the right; a hot shape on the left may be split by AQE.
    return (rows.join(known, shape).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"),
        "template", "template_labelled", "template_bad"))
