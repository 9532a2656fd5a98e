"""URL filtering by path-template trees, in DataFrame expressions only.

Rules of (host, path) decide what they fit; they are also the labels from which the method learns. Every host has a
tree of path segments, as deep as its paths. Segments of digits, or with digits, are variable and become wildcards;
so do, of a node with more than FANOUT branches, those with less than LEAST_SHARE of its urls. Branches of a node are
merged if they are statistically alike: they have the same profile (the next segments that at least LEAST_SHARE of
their urls go on with), and their labels agree: both blocked mostly or both allowed mostly, and no branch's share of
blocked urls differs from that of the others of its group (two-proportion z of LEAST_Z or more). A branch without
labels joins the group of its profile that has most labels. So a node can have several merged groups.

A template's purity is the share of blocked urls among its labelled ones, smoothed with SMOOTHING urls of the node
above it, that one's by the node above, and so on up the tree, the host, the domains that the host belongs to, and the
share among all labelled urls. A template is rejected if its purity reaches PURITY. Where not even the top domain has
a label nothing is known, and templates are allowed.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is allowed. Repeated rows
count and are returned each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.common import written

#: (verdict, host, path) of the rules that the query takes.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
FANOUT, LEAST_SHARE = 32, 0.05
LEAST_Z, SMOOTHING, PURITY = 1.96, 2.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url_col: str) -> tuple[Column, Column]:
    url = F.coalesce(F.col(url_col), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(after, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, like `net/es/`, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def segments() -> Column:
    """The path's segments, variable ones as wildcards, joined by slashes."""
    parts = F.expr("filter(split(path, '/'), s -> s <> '')")
    plain = F.transform(parts, lambda s: F.when(s.rlike("^[0-9]+$"), "{n}").when(s.rlike("[0-9]"), "{x}").otherwise(F.lower(s)))
    return F.array_join(plain, "/")


def _steps(paths: DataFrame, path: str) -> DataFrame:
    """A row for each segment of a path: at (from 0), parent (the segments before it), token; and what follows it, '' at the end."""
    parts = paths.withColumn("__parts", F.split(path, "/")).where(F.col(path) != "")
    step = F.expr("transform(__parts, (t, i) -> struct(i AS at, array_join(slice(__parts, 1, i), '/') AS parent, t AS token, coalesce(get(__parts, i + 1), '') AS following))")
    return parts.withColumn("__step", F.explode(step)).select("*", "__step.*").drop("__parts", "__step")


def merged_branches(paths: DataFrame) -> DataFrame:
    """(host, parent, token, part): what becomes of each branch of the trees of (host, path, n, labelled, blocked)."""
    steps = _steps(paths, "path")
    node = ["host", "parent"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    branch = steps.groupBy(*node, "token").agg(*sums)
    whole = branch.groupBy(*node).agg(F.count("*").alias("branches"), F.sum("n").alias("urls"))
    going = steps.groupBy(*node, "token", "following").agg(F.sum("n").alias("m"))
    going = going.join(branch.select(*node, "token", "n"), [*node, "token"]).where(F.col("m") >= F.col("n") * LEAST_SHARE)
    # at most 1 / LEAST_SHARE of them
    profile = going.groupBy(*node, "token").agg(F.array_join(F.array_sort(F.collect_list("following")), "/").alias("profile"))
    rows = branch.join(whole, node).join(profile, [*node, "token"])
    rare = (F.col("branches") > FANOUT) & (F.col("n") < F.col("urls") * LEAST_SHARE)
    rows = written(rows.withColumn("rare", rare).withColumn("side", F.when(F.col("labelled") == 0, "?").when(F.col("blocked") >= F.col("labelled") * PURITY, "b").otherwise("a")), "url-branches")
    plain = rows.where("not rare")
    kind = [*node, "profile", "side"]
    known = plain.where("side <> '?'").groupBy(*kind).agg(F.sum("labelled").alias("gl"), F.sum("blocked").alias("gb"))
    most = known.groupBy(*node, "profile").agg(F.max_by("side", F.struct("gl", "side")).alias("joins"))
    both = plain.join(known, kind, "left").join(most, [*node, "profile"], "left")
    rest_l, rest_b, share = F.col("gl") - F.col("labelled"), F.col("gb") - F.col("blocked"), F.try_divide("gb", "gl")
    spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest_l)))
    z = F.try_divide(F.abs(F.try_divide("blocked", "labelled") - F.try_divide(rest_b, rest_l)), spread)
    group = F.when(F.coalesce(z >= LEAST_Z, F.lit(False)), F.concat(F.lit("="), "token")).otherwise(F.when(F.col("side") == "?", F.coalesce("joins", "side")).otherwise(F.col("side")))
    grouped = both.select(*node, "profile", "token", group.alias("group"))
    named = grouped.groupBy(*node, "profile", "group").agg(F.count("*").alias("members"), F.min("token").alias("least"))
    plain_parts = grouped.join(named, [*node, "profile", "group"]).select(*node, "token", F.when(F.col("members") > 1, F.concat(F.lit("*"), "least")).otherwise(F.col("token")).alias("part"))
    return plain_parts.union(rows.where("rare").select(*node, "token", F.lit("*").alias("part")))


def _folded(levels: str, start: Column) -> Column:
    """The purity at the end of an array of (l, b) from the top down."""
    return F.aggregate(levels, start, lambda p, e: (e["b"] + F.lit(SMOOTHING) * p) / (e["l"] + F.lit(SMOOTHING)))


def domain_purity(paths: DataFrame, prior: float) -> DataFrame:
    """(host, known, purity): the smoothed share of blocked urls of every host, over its domains; how many labels its top domain has."""
    hosts = paths.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    names = "transform(sequence(1, size(split(host, '[.]'))), i -> struct(i AS level, array_join(slice(split(host, '[.]'), -i, i), '.') AS domain))"
    each = hosts.withColumn("d", F.explode(F.expr(names))).select("host", "d.level", "d.domain", "labelled", "blocked")
    sums = each.groupBy("domain").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    levels = each.join(sums, "domain").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("level", "l", "b"))).alias("levels"))
    return levels.select("host", F.get("levels", F.lit(0))["l"].alias("known"), _folded("levels", F.lit(float(prior))).alias("above"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template, known, purity) of the distinct paths of (host, path, label)."""
    sums = paths.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    paths = written(sums, "url-paths")
    prior = paths.agg(F.try_divide(F.sum("blocked"), F.sum("labelled"))).first()[0] or 0.0
    steps = _steps(paths, "path").join(merged_branches(paths), ["host", "parent", "token"])
    made = steps.groupBy("host", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda e: e["part"]), "/").alias("template"))
    made = written(paths.join(made, ["host", "path"], "left").withColumn("template", F.coalesce("template", F.lit(""))), "url-templates")
    every = written(made.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "template-sums")
    # the labels of every template's nodes, from the first segment down
    nodes = _steps(every, "template").withColumn("node", F.when(F.col("at") == 0, F.col("token")).otherwise(F.concat_ws("/", "parent", "token")))
    labels = nodes.groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    levels = nodes.select("host", "template", "at", "node").join(labels, ["host", "node"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("at", "l", "b"))).alias("levels"))
    none = F.array().cast("array<struct<at:int,l:bigint,b:bigint>>")
    judged = every.select("host", "template").join(levels, ["host", "template"], "left").withColumn("levels", F.coalesce("levels", none)).join(domain_purity(paths, prior), "host")
    purity = judged.select("host", "template", "known", _folded("levels", F.col("above")).alias("purity"))
    return made.select("host", "path", "template").join(purity, ["host", "template"])


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every page's url."""
    host, path = host_and_path(url_col)
    name, says = rule_of(rules)
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select(id_col, "host", "path", name.alias("rule"), says.alias("says"), segments().alias("__path"))
    label = F.expr("case says when 'block' then 1 when 'allow' then 0 end").alias("label")
    learned = templates(urls.where("host <> ''").select("host", F.col("__path").alias("path"), label))
    rejects = (F.col("known") > 0) & (F.col("purity") >= PURITY)
    learned = written(learned.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "template", "purity", F.when(rejects, "block").otherwise("allow").alias("verdict")), "url-verdicts")
    both = urls.join(learned, (F.col("host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
    return both.select(id_col, "host", "path", "rule", F.coalesce("says", "verdict", F.lit("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle(rules=RULES) -> str:
    """The same in DuckDB's SQL."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, h, p)}'" for v, h, p in ordered) + " END"
    steps = lambda table, path: f"""SELECT t.*, i - 1 AS pos, array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS token, coalesce(parts[i + 1], '') AS following
    FROM (SELECT *, string_split({path}, '/') AS parts FROM {table} WHERE {path} <> '') t, unnest(range(1, len(parts) + 1)) u(i)"""  # noqa: E731
    fold = lambda levels, start: f"list_reduce({levels}, lambda a, x: {{'l': 0::DOUBLE, 'b': (x.b + {SMOOTHING}::DOUBLE * a.b) / (x.l + {SMOOTHING}::DOUBLE)}}, {{'l': 0::DOUBLE, 'b': {start}::DOUBLE}}).b"
    pair = "{'l': l::DOUBLE, 'b': b::DOUBLE}"
    return f"""
WITH urls AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
parts AS (SELECT page_id, regexp_extract(u, '^[^/?#]*') AS raw, u FROM urls),
split AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(u, length(raw) + 1), '^[^?#]*') AS path FROM parts),
ruled AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS says,
    array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{n}}' WHEN regexp_matches(s, '[0-9]') THEN '{{x}}' ELSE lower(s) END), '/') AS segs FROM split),
paths AS (SELECT host, segs AS path, count(*) AS n, count(says) AS labelled, count(*) FILTER (says = 'block') AS blocked FROM ruled WHERE host <> '' GROUP BY ALL),
prior AS (SELECT coalesce(sum(blocked) / sum(labelled), 0) AS prior FROM paths),
steps AS ({steps("paths", "path")}),
branch AS (SELECT host, parent, token, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM steps GROUP BY ALL),
whole AS (SELECT host, parent, count(*) AS branches, sum(n) AS urls FROM branch GROUP BY ALL),
going AS (SELECT host, parent, token, following, sum(n) AS m FROM steps GROUP BY ALL),
profile AS (SELECT host, parent, token, array_to_string(list_sort(list(following)), '/') AS profile FROM going JOIN branch USING (host, parent, token) WHERE m >= n * {LEAST_SHARE}::DOUBLE GROUP BY ALL),
b AS (SELECT *, branches > {FANOUT} AND n < urls * {LEAST_SHARE}::DOUBLE AS rare, CASE WHEN labelled = 0 THEN '?' WHEN blocked >= labelled * {PURITY}::DOUBLE THEN 'b' ELSE 'a' END AS side
    FROM branch JOIN whole USING (host, parent) JOIN profile USING (host, parent, token)),
known AS (SELECT host, parent, profile, side, sum(labelled) AS gl, sum(blocked) AS gb FROM b WHERE NOT rare AND side <> '?' GROUP BY ALL),
most AS (SELECT host, parent, profile, arg_max(side, (gl, side)) AS joins FROM known GROUP BY ALL),
z AS (SELECT b.*, gl, gb, joins, CASE WHEN labelled > 0 AND gl > labelled AND gb > 0 AND gb < gl THEN
    abs(blocked / labelled - (gb - blocked) / (gl - labelled)) / sqrt((gb / gl) * (1 - gb / gl) * (1.0::DOUBLE / labelled + 1.0::DOUBLE / (gl - labelled))) END AS z
    FROM b LEFT JOIN known USING (host, parent, profile, side) LEFT JOIN most USING (host, parent, profile) WHERE NOT rare),
grouped AS (SELECT *, CASE WHEN coalesce(z >= {LEAST_Z}, FALSE) THEN '=' || token WHEN side = '?' THEN coalesce(joins, side) ELSE side END AS grp FROM z),
part AS (SELECT host, parent, token, CASE WHEN count(*) OVER w > 1 THEN '*' || min(token) OVER w ELSE token END AS part FROM grouped WINDOW w AS (PARTITION BY host, parent, profile, grp)
    UNION ALL SELECT host, parent, token, '*' FROM b WHERE rare),
made AS (SELECT host, path, string_agg(part, '/' ORDER BY pos) AS template FROM steps JOIN part USING (host, parent, token) GROUP BY ALL),
named AS (SELECT paths.*, coalesce(template, '') AS template FROM paths LEFT JOIN made USING (host, path)),
every AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM named GROUP BY ALL),
nodes AS (SELECT *, CASE WHEN pos = 0 THEN token ELSE parent || '/' || token END AS node FROM ({steps("every", "template")})),
labels AS (SELECT host, node, sum(labelled) AS l, sum(blocked) AS b FROM nodes GROUP BY ALL),
levels AS (SELECT host, template, list({pair} ORDER BY pos) AS levels FROM nodes JOIN labels USING (host, node) GROUP BY ALL),
hosts AS (SELECT host, sum(labelled) AS labelled, sum(blocked) AS blocked FROM paths GROUP BY ALL),
domains AS (SELECT host, i AS level, array_to_string(string_split(host, '.')[-i:], '.') AS domain, labelled, blocked FROM hosts, unnest(range(1, len(string_split(host, '.')) + 1)) u(i)),
domain_labels AS (SELECT domain, sum(labelled) AS l, sum(blocked) AS b FROM domains GROUP BY ALL),
above AS (SELECT host, arg_min(l, level) AS known, {fold(f"list({pair} ORDER BY level)", "any_value(prior)")} AS above FROM domains JOIN domain_labels USING (domain), prior GROUP BY host),
final AS (SELECT named.host, named.path, template, known, CASE WHEN levels IS NULL THEN above ELSE {fold("levels", "above")} END AS purity FROM named LEFT JOIN levels USING (host, template) JOIN above USING (host))
SELECT page_id, ruled.host, ruled.path, rule, coalesce(says, CASE WHEN known > 0 AND purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM ruled LEFT JOIN final ON ruled.host = final.host AND ruled.segs = final.path
"""
