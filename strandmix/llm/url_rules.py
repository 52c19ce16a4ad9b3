"""URL filters by association rules.

FP-growth mines combinations of URL tokens that go with a verdict of labelled pages. Rules are pruned by support, by confidence against
the verdict's share of all labelled pages (lift), and by simpler rules that say as much; they match pages through an inverted index from
a rule's rarest token. Where several fire, the one with the largest lift decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmix.llm.sized import counted, sized_join
from strandmix.llm.storage import written

#: What marks a verdict among tokens. Labelled pages of its verdict that a rule needs, at any size of the corpus, and its lift.
MARK, MIN_PAGES, MIN_LIFT = "=", 10, 1.25

#: Fixed values of the contract: (host, path, verdict).
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: str) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, listed=LISTED) -> tuple[Column, Column]:
    """The longest fitting listed rule and its verdict, null where none fits. A rule fits its host and subdomains, and paths that start with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(listed, key=lambda x: (len(x[0] + x[1]), x)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column, url: str) -> Column:
    """Distinct tokens: host labels, words of hyphenated host labels, path parts without digits, names of query parameters. Empty ones are left out."""
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.rlike("[-_]")), lambda x: F.split(x, "[-_]")))
    parts = F.concat(
        F.transform(labels, lambda x: F.when(x != "", F.concat(F.lit("h:"), x))),
        F.transform(words, lambda x: F.when(x != "", F.concat(F.lit("w:"), x))),
        F.transform(F.split(path, r"[/.\-_0-9]+"), lambda x: F.when(x != "", F.concat(F.lit("p:"), F.lower(x)))),
        F.transform(F.split(query, "&"), lambda x: F.when(x != "", F.concat(F.lit("q:"), F.lower(F.substring_index(x, "=", 1))))),
    )
    return F.array_distinct(F.array_compact(parts))


def _kept(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    table = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"))
    return table.withColumns({"host": host_of("url"), "path": path_of("url")}).withColumn("tokens", tokens_of(F.col("host"), F.col("path"), "url"))


def baskets_of(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """(page, tokens, verdict) of labelled pages: block where the label says bad quality or toxic, else allow.

    Null ids and labels without either figure teach nothing; of several labels of a page the worst counts; each row of a repeated page
    is a basket.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy(F.col(label_id).cast("long").alias("page")).agg(F.max(bad.cast("int")).alias("bad"))
    return _kept(pages, id_col, url_col).join(known, "page").select("page", "tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))


RULES = "tokens array<string>, verdict string, pages long, matched long, lift double, first string"


def _without_implied(baskets: DataFrame) -> DataFrame:
    """Baskets without tokens that say nothing of their own: of tokens that stand on the same pages the first stays, and none that is on all.

    A rule has the same figures with either of two such tokens, so only repetitions of rules are lost, and sets of tokens that always
    come together don't multiply.
    """
    rows = baskets.withColumn("row", F.monotonically_increasing_id())
    uses = written(rows)
    n = uses.count()
    print_of = uses.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("y"))
    stays, m = counted(print_of.where((F.col("n") >= 1) & (F.col("n") < n)).groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token"))
    left = sized_join(uses.select("row", F.explode("tokens").alias("token")), stays, "token", "left_semi", m).groupBy("row").agg(F.collect_list("token").alias("tokens"))
    return uses.select("row", "verdict").join(left, "row", "left").select("verdict", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def mine(baskets: DataFrame, min_pages: int = MIN_PAGES, min_lift: float = MIN_LIFT) -> DataFrame:
    """(tokens, verdict, pages, matched, lift, first) of rules from tokens to a verdict, over baskets with tokens and verdict.

    ``matched`` labelled pages have the tokens, ``pages`` of them the verdict, at least ``min_pages``; ``lift`` is their share against
    the verdict's share of all baskets, at least ``min_lift``. A rule goes when one on some of its tokens has as large a lift. Rules
    may have any number of tokens. ``first`` is the rule's rarest token. Without ``min_pages`` baskets there are no rules.

    FP-growth mines baskets where they are, in parts by item; what passes through the driver is one count for each token that
    ``min_pages`` labelled pages have.
    """
    spark = baskets.sparkSession
    counts = {r.verdict: r["count"] for r in baskets.groupBy("verdict").count().collect()}  # at most two rows
    n = sum(counts.values())
    if n < min_pages:
        return spark.createDataFrame([], RULES)
    items = _without_implied(baskets).select(F.array_append("tokens", F.concat(F.lit(MARK), "verdict")).alias("items"))
    # Half a page less, so that no rounding asks for one more.
    found = written(FPGrowth(itemsCol="items", minSupport=min(1.0, (min_pages - 0.5) / n)).fit(items).freqItemsets)
    marks = [MARK + v for v in counts]
    sets = found.select(F.array_sort(F.filter("items", lambda x: ~x.isin(marks))).alias("tokens"), F.get(F.filter("items", lambda x: x.isin(marks)), F.lit(0)).alias("mark"), "freq").where("freq >= %d AND size(tokens) > 0" % min_pages)
    whole = sets.where("mark IS NULL").select("tokens", F.col("freq").alias("matched"))
    base = F.coalesce(*(F.when(F.col("verdict") == v, F.lit(k / n)) for v, k in counts.items()))
    rules = sets.where("mark IS NOT NULL").select("tokens", F.substring("mark", len(MARK) + 1, 99).alias("verdict"), F.col("freq").alias("pages")).join(whole, "tokens")
    rules, _ = counted(rules.withColumn("lift", F.col("pages") / F.col("matched") / base).where(F.col("lift") >= min_lift))
    # Each rule looks up the rules on some of its tokens.
    subsets = F.expr("aggregate(tokens, array(CAST(array() AS array<string>)), (acc, x) -> concat(acc, transform(acc, s -> array_append(s, x))))")
    subs = rules.select("tokens", "verdict", "lift", F.explode(subsets).alias("sub")).where("size(sub) > 0 AND size(sub) < size(tokens)")
    simpler = rules.select(F.col("tokens").alias("sub"), "verdict", F.col("lift").alias("other"))
    weaker = subs.join(simpler, ["sub", "verdict"]).where("other >= lift").select("tokens", "verdict").distinct()
    rules = rules.join(weaker, ["tokens", "verdict"], "left_anti")
    single = whole.where(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("token"), "matched")
    ranked = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(single.withColumnRenamed("matched", "freq"), "token").groupBy("tokens", "verdict").agg(F.min(F.struct("freq", "token")).alias("rare"))
    return rules.join(ranked, ["tokens", "verdict"]).select("tokens", "verdict", "pages", "matched", "lift", F.col("rare.token").alias("first"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: host, path, listed rule, verdict, how many mined rules fire, and the largest lift of these.

    The verdict is the listed rule's, else that of the mined rule with the largest lift (block before allow), else ``allow``. Null urls,
    and urls without ``://``, have empty host and path, no listed rule and no token but those of their query. Null and repeated ids are
    judged row by row. Pages look rules up by each rule's rarest token; distinct token sets are matched once, so pages of one host cost
    one look-up.
    """
    table = _kept(pages, id_col, url_col).withColumn("set", F.array_sort("tokens"))
    index, n = counted(rules.select("first", F.col("tokens").alias("needed"), F.col("verdict").alias("says"), "lift"))
    sets = table.select("set").distinct()
    hits = sized_join(sets.select("set", F.explode("set").alias("first")), index, "first", "inner", n)
    hits = hits.where(F.size(F.array_except("needed", "set")) == 0).groupBy("set").agg(F.count("*").alias("n_rules"), F.max(F.struct("lift", "says")).alias("best"))
    fired, m = counted(hits)
    rule, verdict = listed_rule(F.col("host"), F.col("path"))
    joined = sized_join(table.select("page", "host", "path", "set"), fired, "set", "left", m)
    return joined.select(
        F.col("page").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("best.says"), F.lit("allow")).alias("verdict"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.col("best.lift").alias("lift")
    )


def filter_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """Mine rules from the labelled pages and judge all pages. Without labelled pages no rule is mined and only listed rules block."""
    return judge(pages, mine(written(baskets_of(pages, labels, id_col, url_col, label_id))), id_col, url_col)


def held_out_lift(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """(verdict, pages, right, share, base): how mined rules do on labelled pages that they weren't mined from.

    Rules come from the pages whose crc32(id as text) mod 4 is not 2. Of the others those are counted on which a rule fires: ``pages`` get
    the verdict, ``right`` of them by their label; ``share`` is right / pages, ``base`` the verdict's share of all pages held out.
    """
    baskets = written(baskets_of(pages, labels, id_col, url_col, label_id))
    held = F.crc32(F.col("page").cast("string").cast("binary")) % 4 == 2
    rules = mine(baskets.where(~held))
    truth = baskets.where(held).groupBy("page").agg(F.max("verdict").alias("truth"))
    table = judge(pages, rules, id_col, url_col).where("n_rules > 0 AND rule IS NULL").select(F.col(id_col).alias("page"), "verdict").join(truth, "page")
    n = max(1, truth.count())
    base = truth.groupBy(F.col("truth").alias("verdict")).agg((F.count("*") / n).alias("base"))
    return table.groupBy("verdict").agg(F.count("*").alias("pages"), F.sum((F.col("verdict") == F.col("truth")).cast("long")).alias("right")).join(base, "verdict", "left").select("verdict", "pages", "right", (F.col("right") / F.col("pages")).alias("share"), "base")


def _listed_sql(rule: bool) -> str:
    ranked = sorted(LISTED, key=lambda x: -len(x[0] + x[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h + p if rule else v}'" for h, p, v in ranked) + " END"


ORACLE = rf"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1) AS q FROM u),
t AS (SELECT DISTINCT page_id, tok FROM (
  SELECT page_id, 'h:' || x AS tok FROM (SELECT page_id, unnest(string_split(host, '.')) AS x FROM h) WHERE x <> ''
  UNION ALL SELECT page_id, 'w:' || x FROM (SELECT page_id, unnest(string_split_regex(y, '[-_]')) AS x FROM (SELECT page_id, unnest(string_split(host, '.')) AS y FROM h) WHERE regexp_matches(y, '[-_]')) WHERE x <> ''
  UNION ALL SELECT page_id, 'p:' || lower(x) FROM (SELECT page_id, unnest(string_split_regex(path, '[/.\-_0-9]+')) AS x FROM h) WHERE x <> ''
  UNION ALL SELECT page_id, 'q:' || lower(string_split(x, '=')[1]) FROM (SELECT page_id, unnest(string_split(q, '&')) AS x FROM h) WHERE x <> '')),
l AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
b AS (SELECT page_id, CASE WHEN bad = 1 THEN 'block' ELSE 'allow' END AS verdict FROM l JOIN pages USING (page_id)),
nv AS (SELECT verdict, count(*) AS k, sum(count(*)) OVER () AS n FROM b GROUP BY 1),
o AS (SELECT tok, list(page_id ORDER BY page_id) AS ids FROM t JOIN b USING (page_id) GROUP BY 1),
s AS (SELECT min(tok) AS tok, ids FROM o WHERE len(ids) < (SELECT count(*) FROM b) GROUP BY ids HAVING len(ids) >= {MIN_PAGES}),
sets AS (SELECT [tok] AS toks, ids FROM s
  UNION ALL SELECT list_append(toks, s.tok), list_sort(list_intersect(sets.ids, s.ids)) FROM sets JOIN s ON s.tok > toks[-1] AND len(list_intersect(sets.ids, s.ids)) >= {MIN_PAGES}),
c AS (SELECT toks, verdict, pages, len(ids) AS matched, pages::DOUBLE / len(ids)::DOUBLE / (k::DOUBLE / n::DOUBLE) AS lift
  FROM (SELECT toks, ids, verdict, count(*) AS pages FROM (SELECT toks, ids, unnest(ids) AS page_id FROM sets) JOIN b USING (page_id) GROUP BY 1, 2, 3) JOIN nv USING (verdict)
  WHERE pages >= {MIN_PAGES} AND pages::DOUBLE / len(ids)::DOUBLE / (k::DOUBLE / n::DOUBLE) >= {MIN_LIFT}::DOUBLE),
r AS (SELECT toks, verdict, lift FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.verdict = c.verdict AND len(d.toks) < len(c.toks) AND list_has_all(c.toks, d.toks) AND d.lift >= c.lift)),
f AS (SELECT page_id, count(*) AS n_rules, max(lift) AS lift, arg_max(r.verdict, (lift, r.verdict)) AS says FROM (SELECT page_id, list(tok) AS toks FROM t GROUP BY 1) p, r WHERE list_has_all(p.toks, r.toks) GROUP BY 1)
SELECT h.page_id, host, path, {_listed_sql(True)} AS rule, coalesce({_listed_sql(False)}, says, 'allow') AS verdict, coalesce(n_rules, 0) AS n_rules, f.lift AS lift
FROM h LEFT JOIN f ON h.page_id = f.page_id
"""
