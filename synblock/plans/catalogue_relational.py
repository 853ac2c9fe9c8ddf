"""Joins, aggregations, windows, set operations and scalar functions over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock.functions import columns as C
from synblock.operators import hits, ranks
from synblock.plans.catalogue import over, query
from synblock.plans.workload import Tables

L = "lineitem"


@query("SELECT ofID, chr, CAST(\"end\" - start + 1 AS BIGINT) AS size FROM genes WHERE pepLen > 300", "genes")
def prj01_select_filter(t: Tables) -> DataFrame:
    return t.genes.where("pepLen > 300").select("ofID", "chr", (F.col("end") - F.col("start") + 1).alias("size"))


@query("SELECT ofID2 AS ofID1, ofID1 AS ofID2, genome2 AS genome1, genome1 AS genome2, ord2 AS ord1, ord1 AS ord2, bitScore FROM hits", "hits")
def prj04_swap_ends(t: Tables) -> DataFrame:
    from synblock.operators.hits import swapped

    return swapped(t.hits.select("ofID1", "ofID2", "genome1", "genome2", "ord1", "ord2", "bitScore"))


@query("SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL AND value > 10")
def flt02_complete_rows(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "value", "event_type").dropna().where("value > 10").drop("event_type")


@query("SELECT * FROM (SELECT genome, chr, og, ofID, count(*) OVER (PARTITION BY genome, og) AS n FROM genes) WHERE n >= 3", "genes")
def flt04_group_threshold(t: Tables) -> DataFrame:
    return t.genes.select("genome", "chr", "og", "ofID").withColumn("n", F.count(F.lit(1)).over(over("genome", "og"))).where("n >= 3")


@query("SELECT o_custkey, coalesce(bool_or(o_totalprice > 200000), false) AS rich, bool_and(o_totalprice > 1000) AS steady FROM orders GROUP BY o_custkey")
def flt05_any_all(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(C.any_true(F.col("o_totalprice") > 200000).alias("rich"), F.bool_and(F.col("o_totalprice") > 1000).alias("steady"))


@query("SELECT ofID1, ofID2, chr1 FROM hits WHERE chr1 = chr2", "hits")
def flt07_same_chromosome(t: Tables) -> DataFrame:
    return t.hits.where("chr1 = chr2").select("ofID1", "ofID2", "chr1")


@query("SELECT ofID, CASE WHEN pepLen > 400 THEN 'long' WHEN pepLen > 200 THEN 'middle' ELSE 'short' END AS label FROM genes", "genes")
def flt08_labels(t: Tables) -> DataFrame:
    return t.genes.select("ofID", F.when(F.col("pepLen") > 400, "long").when(F.col("pepLen") > 200, "middle").otherwise("short").alias("label"))


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def jn02_left(t: Tables) -> DataFrame:
    o = t.orders.where("o_totalprice > 300000").select("o_custkey", "o_orderkey", "o_totalprice")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, c_custkey, c_acctbal FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN orders ON c_custkey = o_custkey")
def jn03_right(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_custkey", "c_acctbal")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) b ON a.k = b.k")
def jn04_full(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers")), "k", "outer")


@query("SELECT a.ofID AS ofID1, b.ofID AS ofID2, a.og FROM genes a JOIN genes b ON a.og = b.og AND a.genome = 'G0' AND b.genome = 'G1'", "genes")
def jn05_many_to_many(t: Tables) -> DataFrame:
    g = t.genes.select("og", "genome", "ofID")
    return g.where("genome = 'G0'").select("og", F.col("ofID").alias("ofID1")).join(g.where("genome = 'G1'").select("og", F.col("ofID").alias("ofID2")), "og")


@query("SELECT p_partkey, p_name, f.sup FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS sup FROM lineitem GROUP BY l_partkey) f ON p_partkey = l_partkey")
def jn06_dictionary(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("sup"))
    return t.part.join(first, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", "sup")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def jn07_semi(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_quantity > 48"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def jn08_anti(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT r_name, seg, coalesce(n, 0) AS n FROM (SELECT r_name, seg FROM region, (SELECT DISTINCT c_mktsegment seg FROM customer)) LEFT JOIN (SELECT r_name AS r, c_mktsegment AS s, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000 GROUP BY 1, 2) ON r = r_name AND s = seg")
def jn16_grid(t: Tables) -> DataFrame:
    n = t.customer.where("c_acctbal > 9000").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.groupBy("r_name", F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    segments = t.customer.agg(F.collect_set("c_mktsegment").alias("s"))  # one row of a few names
    grid = t.region.select("r_name").join(F.broadcast(segments), F.lit(True)).select("r_name", F.explode("s").alias("seg"))
    return grid.join(n, ["r_name", "seg"], "left").na.fill(0, ["n"])


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def jn17_pairs(t: Tables) -> DataFrame:
    n = t.nation.select("n_regionkey", "n_nationkey", "n_name")
    b = n.select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return n.join(b, "n_regionkey").where("n_nationkey < k").select(F.col("n_name").alias("a"), "b")


# Aggregations


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def ag01_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def ag02_count_back(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(over("o_custkey")).alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def ag03_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT ofID, n FROM genes JOIN (SELECT genome, chr, count(DISTINCT og) AS n FROM genes GROUP BY 1, 2) USING (genome, chr)", "genes")
def ag04_windowed_distinct(t: Tables) -> DataFrame:
    return t.genes.join(t.genes.groupBy("genome", "chr").agg(F.count_distinct("og").alias("n")), ["genome", "chr"]).select("ofID", "n")


@query("SELECT o_custkey, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS n FROM orders GROUP BY 1")
def ag05_conditional_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("n"))


@query("SELECT genome, chr, min(start) AS lo, max(\"end\") AS hi, min(ord) AS o1, max(ord) AS o2 FROM ranked GROUP BY 1, 2", "ranked")
def ag06_bounding_box(t: Tables) -> DataFrame:
    return t.ranked.groupBy("genome", "chr").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.min("ord").alias("o1"), F.max("ord").alias("o2"))


@query("SELECT genome, chr, arg_min(ofID, ord) AS first, arg_max(ofID, ord) AS last FROM ranked GROUP BY 1, 2", "ranked")
def ag07_first_last(t: Tables) -> DataFrame:
    return t.ranked.groupBy("genome", "chr").agg(F.min_by("ofID", "ord").alias("first"), F.max_by("ofID", "ord").alias("last"))


@query("SELECT l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY 1")
def ag08_median(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.median("l_quantity").alias("m"))


@query("SELECT genome, quantile_cont(pepLen, 0.25) AS q1, quantile_cont(pepLen, 0.75) AS q3 FROM genes GROUP BY 1", "genes")
def ag09_quantile(t: Tables) -> DataFrame:
    return t.genes.groupBy("genome").agg(F.percentile("pepLen", F.lit(0.25)).alias("q1"), F.percentile("pepLen", F.lit(0.75)).alias("q3"))


@query("SELECT genome, chr, round(CAST(sum(pepLen) AS DOUBLE) / count(*), 6) AS m FROM genes GROUP BY 1, 2", "genes")
def ag10_mean(t: Tables) -> DataFrame:
    return t.genes.groupBy("genome", "chr").agg(F.round(F.sum("pepLen").cast("double") / F.count(F.lit(1)), 6).alias("m"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.02) AS cheap FROM lineitem GROUP BY 1")
def ag11_boolean_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if((F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.02)).alias("cheap"))


@query("SELECT genome1, genome2, chr1, chr2, n, CASE WHEN r < 0 THEN '-' ELSE '+' END AS orient FROM (SELECT genome1, genome2, chr1, chr2, count(*) AS n, corr(CAST(ord1 AS DOUBLE), CAST(ord2 AS DOUBLE)) AS r FROM hits GROUP BY ALL) WHERE n >= 20", "hits")
def ag12_orientation(t: Tables) -> DataFrame:
    g = t.hits.groupBy("genome1", "genome2", "chr1", "chr2").agg(F.count(F.lit(1)).alias("n"), F.covar_pop(F.col("ord1").cast("double"), F.col("ord2").cast("double")).alias("r"))
    return g.where("n >= 20").withColumn("orient", F.when(F.col("r") < 0, "-").otherwise("+")).drop("r")


@query("SELECT genome, og, string_agg(ofID, ',' ORDER BY ofID) AS members FROM genes GROUP BY 1, 2", "genes")
def ag13_string_aggregation(t: Tables) -> DataFrame:
    return t.genes.groupBy("genome", "og").agg(F.array_join(F.sort_array(F.collect_list("ofID")), ",").alias("members"))


@query("SELECT og, coalesce(string_agg(ofID, ',' ORDER BY ofID) FILTER (genome = 'G0'), '') AS G0, coalesce(string_agg(ofID, ',' ORDER BY ofID) FILTER (genome = 'G1'), '') AS G1, coalesce(string_agg(ofID, ',' ORDER BY ofID) FILTER (genome = 'G2'), '') AS G2 FROM genes GROUP BY og", "genes")
def ag14_list_pivot(t: Tables) -> DataFrame:
    wide = t.genes.groupBy("og").pivot("genome", ["G0", "G1", "G2"]).agg(F.sort_array(F.collect_list("ofID")))
    return wide.select("og", *(F.array_join(F.coalesce(g, F.array()), ",").alias(g) for g in ("G0", "G1", "G2")))


@query("SELECT c_mktsegment, c_nationkey, n, round(100.0::DOUBLE * n / CAST(sum(n) OVER (PARTITION BY c_nationkey) AS DOUBLE), 6) AS perc FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)")
def ag15_percent_of_total(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("perc", F.round(100.0 * F.col("n") / F.sum("n").over(over("c_nationkey")).cast("double"), 6))


@query("SELECT genome, og, chr, n, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY genome, og), 6) AS prop FROM (SELECT genome, og, chr, count(*) AS n FROM genes GROUP BY 1, 2, 3)", "genes")
def ag16_share_of_largest(t: Tables) -> DataFrame:
    n = t.genes.groupBy("genome", "og", "chr").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("prop", F.round(F.col("n").cast("double") / F.max("n").over(over("genome", "og")), 6))


@query("SELECT l_suppkey, avg(CASE WHEN l_discount > 0.09 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.05 AS flagged FROM lineitem GROUP BY 1")
def ag17_share_flag(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg((F.avg(F.when(F.col("l_discount") > 0.09, 1.0).otherwise(0.0)) > 0.05).alias("flagged"))


@query("SELECT genome, max(pepLen) AS n50 FROM (SELECT genome, pepLen, sum(pepLen) OVER (PARTITION BY genome ORDER BY pepLen DESC) AS c, sum(pepLen) OVER (PARTITION BY genome) AS t FROM genes) WHERE c * 2 >= t GROUP BY genome", "genes")
def ag18_n50(t: Tables) -> DataFrame:
    return ranks.n50(t.genes, ["genome"], "pepLen")


@query("SELECT genome1, genome2, count(*) AS nHits, count(DISTINCT ofID1) AS n1, count(DISTINCT ofID2) AS n2, count(DISTINCT blkID) AS nBlks, count(DISTINCT blkID) - count(DISTINCT chr1 || ' ' || chr2) AS nSVs FROM blocks GROUP BY 1, 2", "blocks")
def ag20_pair_summary(t: Tables) -> DataFrame:
    b = t.blocks.groupBy("genome1", "genome2").agg(F.count(F.lit(1)).alias("nHits"), F.count_distinct("ofID1").alias("n1"), F.count_distinct("ofID2").alias("n2"), F.count_distinct("blkID").alias("nBlks"), F.count_distinct(F.concat_ws(" ", "chr1", "chr2")).alias("p"))
    return b.withColumn("nSVs", F.col("nBlks") - F.col("p")).drop("p")


@query("SELECT genome2, count(*) FILTER (n = 0) AS n0, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n > 2) AS more FROM (SELECT g.ofID, g2.genome AS genome2, count(h.ofID2) AS n FROM genes g CROSS JOIN (SELECT DISTINCT genome FROM genes WHERE genome <> 'G0') g2 LEFT JOIN hits h ON h.ofID1 = g.ofID AND h.genome2 = g2.genome WHERE g.genome = 'G0' GROUP BY 1, 2) GROUP BY 1", "hits")
def ag21_position_census(t: Tables) -> DataFrame:
    n = t.hits.where("genome1 = 'G0'").groupBy("genome2", "ofID1").agg(F.count(F.lit(1)).alias("n"))
    total = t.genes.where("genome = 'G0'").agg(F.count(F.lit(1)).alias("total"))
    c = n.groupBy("genome2").agg(F.count(F.lit(1)).alias("have"), *(F.count_if(F.expr(e)).alias(k) for k, e in (("n1", "n = 1"), ("n2", "n = 2"), ("more", "n > 2"))))
    return c.join(F.broadcast(total), F.lit(True)).select("genome2", (F.col("total") - F.col("have")).alias("n0"), "n1", "n2", "more")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def ag22_distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("SELECT ofID1, ofID2, bitScore FROM (SELECT *, row_number() OVER (PARTITION BY ofID1 ORDER BY bitScore DESC, ofID2) AS r FROM hits) WHERE r = 1", "hits")
def ag23_keep_first(t: Tables) -> DataFrame:
    return ranks.keep_first(t.hits.select("ofID1", "ofID2", "bitScore"), ["ofID1"], [F.desc("bitScore"), "ofID2"])


# Windows


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def wn01_row_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.row_number().over(over("o_custkey", order=["o_orderdate", "o_orderkey"])).cast("long").alias("rn"))


@query("SELECT ofID1, ofID2, dense_rank() OVER (PARTITION BY genome1, genome2 ORDER BY ord1) AS r1, dense_rank() OVER (PARTITION BY genome1, genome2 ORDER BY ord2) AS r2 FROM hits", "hits")
def wn02_dense_rank_pair(t: Tables) -> DataFrame:
    return hits.ranked_pairs(t.ranked).select("ofID1", "ofID2", "r1", "r2")


@query("SELECT ofID1, ofID2, dense_rank() OVER (PARTITION BY ofID1 ORDER BY -round_even(bitScore, -1)) AS sr FROM hits", "hits")
def wn03_dense_rank_group(t: Tables) -> DataFrame:
    return ranks.dense_rank(t.hits, ["ofID1"], -F.bround("bitScore", -1), "sr").select("ofID1", "ofID2", "sr")


@query("SELECT ofID, rank() OVER (PARTITION BY genome ORDER BY pepLen) + (count(*) OVER (PARTITION BY genome, pepLen) - 1) / 2.0::DOUBLE AS r FROM genes", "genes")
def wn05_rank_average(t: Tables) -> DataFrame:
    return ranks.rank_average(t.genes, ["genome"], "pepLen", "r").select("ofID", "r")


@query("SELECT ofID, ord - lag(ord) OVER (PARTITION BY genome, og ORDER BY ord) AS d FROM ranked", "ranked")
def wn07_lag_difference(t: Tables) -> DataFrame:
    return t.ranked.select("ofID", (F.col("ord") - F.lag("ord").over(over("genome", "og", order=["ord"]))).alias("d"))


@query("SELECT ofID, CAST(sum(j) OVER (PARTITION BY genome, og ORDER BY ord) + 1 AS BIGINT) AS session FROM (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY genome, og ORDER BY ord) > 50 THEN 1 ELSE 0 END AS j FROM ranked)", "ranked")
def wn08_gap_sessions(t: Tables) -> DataFrame:
    return ranks.gap_sessions(t.ranked, ["genome", "og"], "ord", 50, "session").select("ofID", "session")


@query("SELECT event_id, run, count(*) OVER (PARTITION BY user_id, run) AS len FROM (SELECT *, CAST(sum(j) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS j FROM events))")
def wn09_run_lengths(t: Tables) -> DataFrame:
    return ranks.run_lengths(t.events, ["user_id"], ["ts", "event_id"], "event_type", "run", "len").select("event_id", "run", "len")


@query("SELECT ofID, CAST(sum(pepLen) OVER (PARTITION BY genome, chr ORDER BY ord) AS BIGINT) AS c, least(CAST(sum(pepLen) OVER (PARTITION BY genome, chr ORDER BY ord) AS BIGINT), 10000) AS capped FROM ranked", "ranked")
def wn10_running_sum(t: Tables) -> DataFrame:
    c = F.sum("pepLen").over(over("genome", "chr", order=["ord"]).rowsBetween(Window.unboundedPreceding, 0))
    return t.ranked.select("ofID", c.alias("c"), F.least(c, F.lit(10000)).alias("capped"))


@query("SELECT genome, chr, CAST(coalesce(sum(n) OVER (PARTITION BY genome ORDER BY lo, chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT genome, chr, count(*) AS n, min(ord) AS lo FROM ranked GROUP BY 1, 2)", "ranked")
def wn11_exclusive_sum(t: Tables) -> DataFrame:
    n = t.ranked.groupBy("genome", "chr").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("lo"))
    return n.select("genome", "chr", ranks.exclusive_sum("n", ["genome"], ["lo", "chr"]).alias("off"))


@query("SELECT ofID, first_value(ofID) OVER (PARTITION BY genome, og ORDER BY pepLen DESC, ord) AS rep FROM ranked", "ranked")
def wn12_first_value(t: Tables) -> DataFrame:
    return t.ranked.select("ofID", F.first("ofID").over(over("genome", "og", order=[F.desc("pepLen"), "ord"])).alias("rep"))


@query("SELECT ofID, max(pepLen) OVER (PARTITION BY og) AS hi, min(pepLen) OVER (PARTITION BY og) AS lo FROM genes", "genes")
def wn13_group_extremes(t: Tables) -> DataFrame:
    return t.genes.select("ofID", F.max("pepLen").over(over("og")).alias("hi"), F.min("pepLen").over(over("og")).alias("lo"))


@query("SELECT genome, og, max(abs(d)) AS far FROM (SELECT genome, og, ord - lag(ord) OVER (PARTITION BY genome, og ORDER BY ord) AS d FROM ranked) GROUP BY 1, 2", "ranked")
def wn14_largest_step(t: Tables) -> DataFrame:
    d = F.col("ord") - F.lag("ord").over(over("genome", "og", order=["ord"]))
    return t.ranked.select("genome", "og", d.alias("d")).groupBy("genome", "og").agg(F.max(F.abs("d")).alias("far"))


@query("SELECT ofID, dense_rank() OVER (PARTITION BY genome ORDER BY f, og) AS code FROM (SELECT *, min(ord) OVER (PARTITION BY genome, og) AS f FROM ranked)", "ranked")
def wn15_code_by_appearance(t: Tables) -> DataFrame:
    return ranks.code_by_appearance(t.ranked, ["genome"], "og", "ord", "code").select("ofID", "code")


@query("SELECT ofID, dense_rank() OVER (PARTITION BY genome ORDER BY og) AS code FROM genes", "genes")
def wn16_sorted_code(t: Tables) -> DataFrame:
    return ranks.dense_rank(t.genes, ["genome"], "og", "code").select("ofID", "code")


@query("SELECT ofID, ord - min(ord) OVER (PARTITION BY genome, chr) + 1 AS ord FROM ranked", "ranked")
def wn17_recentre(t: Tables) -> DataFrame:
    from synblock.plans.layout import recentred

    return recentred(t.ranked).select("ofID", "ord")


@query("SELECT genome, chr, (row_number() OVER (PARTITION BY genome ORDER BY lo, chr) - 1) % 5 + 1 AS colour FROM (SELECT genome, chr, min(ord) AS lo FROM ranked GROUP BY 1, 2)", "ranked")
def wn19_cyclic_index(t: Tables) -> DataFrame:
    c = t.ranked.groupBy("genome", "chr").agg(F.min("ord").alias("lo"))
    return c.select("genome", "chr", ((F.row_number().over(over("genome", order=["lo", "chr"])) - 1) % 5 + 1).cast("long").alias("colour"))


# Top-k, sets, shapes


@query("SELECT ofID1, ofID2, bitScore FROM (SELECT *, dense_rank() OVER (PARTITION BY genome1, genome2, ofID1 ORDER BY -round_even(bitScore, -1)) AS a, dense_rank() OVER (PARTITION BY genome1, genome2, ofID2 ORDER BY -round_even(bitScore, -1)) AS b FROM hits) WHERE a <= 1 AND b <= 1", "hits")
def so04_top_both(t: Tables) -> DataFrame:
    from synblock.operators.hits import top_both

    return top_both(t.hits, 1, 1).select("ofID1", "ofID2", "bitScore")


@query("SELECT ofID1, ofID2 FROM (SELECT *, row_number() OVER (PARTITION BY genome1, genome2, ofID1 ORDER BY bitScore DESC, ofID2) AS a, row_number() OVER (PARTITION BY genome1, genome2, ofID2 ORDER BY bitScore DESC, ofID1) AS b FROM hits) WHERE a = 1 AND b = 1", "hits")
def so05_reciprocal_best(t: Tables) -> DataFrame:
    from synblock.operators.hits import reciprocal_best

    return reciprocal_best(t.hits, ["genome1", "genome2"]).select("ofID1", "ofID2")


@query("SELECT og, genome, ofID FROM (SELECT *, row_number() OVER (PARTITION BY og, genome ORDER BY ord) AS r FROM ranked) WHERE r <= 2", "ranked")
def so08_member_cap(t: Tables) -> DataFrame:
    return ranks.keep_top(t.ranked.select("og", "genome", "ofID", "ord"), ["og", "genome"], ["ord"], 2).drop("ord")


@query("SELECT ofID, chr, TRY_CAST(regexp_replace(chr, '[^0-9]+', '', 'g') AS DOUBLE) AS n FROM genes", "genes")
def so11_chromosome_number(t: Tables) -> DataFrame:
    return t.genes.select("ofID", "chr", C.chromosome_number(F.col("chr")).alias("n"))


@query("SELECT c_custkey AS k, c_acctbal AS bal, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def set01_union_all(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.lit("customer").alias("kind"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("kind")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set02_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set03_intersect(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000")
def set04_except(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.customer.where("c_acctbal < 5000").select("c_custkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, name, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_discount, l_tax))")
def set05_wide_to_long(t: Tables) -> DataFrame:
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "name", "value")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def set06_long_to_wide(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT g.genome, o.og, count(x.ofID) AS n FROM (SELECT DISTINCT genome FROM genes) g CROSS JOIN (SELECT DISTINCT og FROM genes) o LEFT JOIN genes x ON x.genome = g.genome AND x.og = o.og GROUP BY 1, 2", "genes")
def set08_complete_grid(t: Tables) -> DataFrame:
    n = t.genes.groupBy("genome", "og").agg(F.count(F.lit(1)).alias("n"))
    names = t.genes.agg(F.collect_set("genome").alias("gs"))  # one row, a name a genome
    grid = t.genes.select("og").distinct().join(F.broadcast(names), F.lit(True)).select("og", F.explode("gs").alias("genome"))
    return grid.join(n, ["genome", "og"], "left").na.fill(0, ["n"])


# Scalar functions


@query("SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z]+', '_', 'g') AS a, regexp_matches(p_name, '1') AS b, split_part(p_type, ' ', 1) AS c, trim('  ' || p_brand || ' ') AS d, lower(p_brand) AS e, upper(p_name) AS f, substr(p_brand, 2, 3) AS g, lpad(CAST(p_size AS VARCHAR), 5, '0') AS h, 'part ' || p_size || ': ' || p_brand AS i FROM part")
def sf01_strings(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.regexp_replace("p_type", "[^A-Za-z]+", "_").alias("a"), F.col("p_name").rlike("1").alias("b"), F.get(F.split("p_type", " "), 0).alias("c"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("d"),
        F.lower("p_brand").alias("e"), F.upper("p_name").alias("f"), F.substring("p_brand", 2, 3).alias("g"), F.lpad(F.col("p_size").cast("string"), 5, "0").alias("h"), F.concat(F.lit("part "), F.col("p_size").cast("string"), F.lit(": "), "p_brand").alias("i"),
    )


@query("SELECT o_orderkey, round_even(o_totalprice / 1000, 0) * 1000 AS a, floor(o_totalprice)::BIGINT AS b, ceil(o_totalprice)::BIGINT AS c, abs(o_totalprice - 100000) AS d, sqrt(o_totalprice) AS e, least(o_totalprice, 50000) AS f, greatest(o_totalprice, 50000) AS g FROM orders")
def sf09_numbers(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", C.round_to(p, 1000).alias("a"), F.floor(p).alias("b"), F.ceil(p).alias("c"), F.abs(p - 100000).alias("d"), F.sqrt(p).alias("e"), F.least(p, F.lit(50000.0)).alias("f"), F.greatest(p, F.lit(50000.0)).alias("g"))


@query("SELECT ofID, CASE WHEN hi > lo THEN round((pepLen - lo) / CAST(hi - lo AS DOUBLE) * 9 + 1, 6) ELSE 5.5 END AS s FROM (SELECT *, min(pepLen) OVER (PARTITION BY og) AS lo, max(pepLen) OVER (PARTITION BY og) AS hi FROM genes)", "genes")
def sf13_rescale(t: Tables) -> DataFrame:
    return t.genes.select("ofID", F.round(C.scale_between(F.col("pepLen").cast("double"), 1, 10, [F.col("og")]), 6).alias("s"))


@query("SELECT p_partkey, i AS i, round(p_size * (1 - cos(pi() * i / 10.0::DOUBLE)) / 2, 6) AS y FROM part, range(0, 11) r(i)")
def sf14_curve(t: Tables) -> DataFrame:
    s = t.part.select("p_partkey", "p_size", F.explode(F.expr("sequence(0L, 10L)")).alias("i"))
    return s.select("p_partkey", "i", F.round(F.col("p_size") * (1 - F.cos(F.pi() * F.col("i") / 10.0)) / 2, 6).alias("y"))


@query("SELECT doc_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) AS rc, regexp_full_match(upper(text), '[ACGTN]*') AS dna, length(translate(text, '.-', '')) AS n, TRY_CAST(substr(source, 4) AS BIGINT) AS k, coalesce(nullif(lang, 'en'), 'none') AS l FROM documents")
def sf18_sequences(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", C.reverse_complement(text).alias("rc"), C.only_dna(text).alias("dna"), F.length(C.strip_marks(F.col("text"))).cast("long").alias("n"), F.substring("source", 4, 9).try_cast("long").alias("k"), F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.lit("none")).alias("l"))


@query("SELECT n_nationkey, lpad(n_name, (SELECT max(length(n_name)) FROM nation)::INT, ' ') AS a, rpad(n_name, (SELECT max(length(n_name)) FROM nation)::INT, ' ') AS b FROM nation")
def sf07_justify(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", C.justified(t.nation, "n_name").alias("a"), C.justified(t.nation, "n_name", False).alias("b"))


@query("SELECT ofID AS ofID1, genome AS genome1, chr AS chr1, ord AS ord1 FROM ranked", "ranked")
def prj03_suffix(t: Tables) -> DataFrame:
    return t.ranked.select(*(F.col(c).alias(f"{c}1") for c in ("ofID", "genome", "chr", "ord")))


@query("SELECT doc_id, source FROM (SELECT *, nullif(lang, 'en') AS l FROM documents) d WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT nullif(lang, 'en') AS l FROM documents WHERE lang IN ('en', 'de')) s WHERE s.l IS NOT DISTINCT FROM d.l)")
def flt03_null_safe_membership(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "lang", F.nullif(F.col("lang"), F.lit("en")).alias("l"))
    s = d.where("lang in ('en', 'de')").select(F.col("l").alias("k")).distinct()
    return d.join(s, F.col("l").eqNullSafe(F.col("k")), "left_semi").select("doc_id", "source")


@query("SELECT ofID1, ofID2, row_number() OVER (PARTITION BY genome1, genome2, ofID1 ORDER BY bitScore DESC, ord2, ofID2) AS r FROM hits", "hits")
def wn04_rank_first(t: Tables) -> DataFrame:
    return t.hits.select("ofID1", "ofID2", F.row_number().over(over("genome1", "genome2", "ofID1", order=[F.desc("bitScore"), "ord2", "ofID2"])).cast("long").alias("r"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY nullif(lang, 'en') ASC NULLS FIRST, n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY nullif(lang, 'en') ASC NULLS LAST, doc_id) AS b FROM documents")
def so01_null_order(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars", F.nullif(F.col("lang"), F.lit("en")).alias("l"))
    row = lambda *o: F.row_number().over(over("source", order=list(o))).cast("long")
    return d.select("doc_id", row(F.col("l").asc_nulls_first(), F.desc("n_chars"), "doc_id").alias("a"), row(F.col("l").asc_nulls_last(), "doc_id").alias("b"))


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY genome1, genome2, ofID1 ORDER BY bitScore DESC, ofID2) AS r FROM hits), b AS (SELECT *, row_number() OVER (PARTITION BY genome1, genome2, ofID2 ORDER BY bitScore DESC, ofID1) AS q FROM a WHERE r = 1) SELECT ofID1, ofID2, bitScore FROM b WHERE q = 1", "hits")
def so07_best_in_two_passes(t: Tables) -> DataFrame:
    once = ranks.keep_first(t.hits.select("genome1", "genome2", "ofID1", "ofID2", "bitScore"), ["genome1", "genome2", "ofID1"], [F.desc("bitScore"), "ofID2"])
    return ranks.keep_first(once, ["genome1", "genome2", "ofID2"], [F.desc("bitScore"), "ofID1"]).drop("genome1", "genome2")


@query("SELECT genome, chr, max(e) AS hi FROM (SELECT genome1 AS genome, chr1 AS chr, end1 AS e FROM hits UNION ALL SELECT genome2, chr2, end2 FROM hits) GROUP BY 1, 2", "hits")
def ag19_stacked_extent(t: Tables) -> DataFrame:
    ends = lambda n: t.hits.select(F.col(f"genome{n}").alias("genome"), F.col(f"chr{n}").alias("chr"), F.col(f"end{n}").alias("e"))
    return ends(1).unionByName(ends(2)).groupBy("genome", "chr").agg(F.max("e").alias("hi"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ag24_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))
