"""The queries of the core library and the same statements in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denspark.functions import vectors as V
from denspark.operators import boxes, grid, neighbors, scans
from denspark.operators.components import least_reachable, spanning_forest
from denspark.operators.points import Extent, extent, to_points
from denspark.plans import metrics
from denspark.plans.cluster import Stages, dbscan
from denspark.plans.estimator import SparkDBSCAN, counts


@dataclass(frozen=True)
class Source:
    """A table of points in both engines, with the parameters it is clustered with."""

    table: str
    id: str
    spark: tuple[str, ...]
    duck: tuple[str, ...]
    eps: float
    least: int

    @property
    def dim(self) -> int:
        return len(self.spark)

    def points(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return to_points(rows, [F.expr(x) for x in self.spark], self.id)

    @property
    def p(self) -> str:
        return "p as materialized (select " + f"{self.id}::bigint id, " + ", ".join(f"({x})::double c{i}" for i, x in enumerate(self.duck)) + f" from {self.table})"


def _embedding(dim: int, eps: float) -> Source:
    return Source("embeddings", "vec_id", tuple(f"embedding[{i}]" for i in range(dim)), tuple(f"embedding[{i + 1}]" for i in range(dim)), eps, 5)


E2, E2B, E3, E5 = _embedding(2, 0.03), _embedding(2, 0.02), _embedding(3, 0.06), _embedding(5, 0.15)
CUSTOMER = Source("customer", "c_custkey", ("c_acctbal / 1000", "c_nationkey"), ("c_acctbal / 1000", "c_nationkey"), 0.3, 5)
SUPPLIER = Source("supplier", "s_suppkey", ("s_acctbal / 1000", "s_nationkey"), ("s_acctbal / 1000", "s_nationkey"), 1.0, 3)
EVENTS = Source(
    "events", "event_id", ("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts) / 3600000000D", "value / 10"), ("epoch_us(ts - timestamp '2024-01-01') / 3600000000::double", "value / 10"), 1.0, 8
)


def _num(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _d2(dim: int, a: str = "a", b: str = "b") -> str:
    return "+".join(f"({a}.c{i}-{b}.c{i})*({a}.c{i}-{b}.c{i})" for i in range(dim))


def _cells(s: Source) -> str:
    side = _num(grid.side_of(s.eps, s.dim))
    return (
        f"{s.p}, m as (select {', '.join(f'min(c{i}) m{i}' for i in range(s.dim))} from p), "
        f"g as materialized (select p.*, {', '.join(f'floor((c{i}-m{i})/{side})::bigint k{i}' for i in range(s.dim))} from p, m)"
    )


def _pairs(s: Source) -> str:
    return f"{_cells(s)}, pr as materialized (select a.id a, b.id b, {_d2(s.dim)} d2 from g a join g b on {_d2(s.dim)} <= {_num(s.eps * s.eps)})"


def _core(s: Source) -> str:
    return f"{_pairs(s)}, core as materialized (select a id from pr group by a having count(*) >= {s.least})"


def _components(s: Source) -> str:
    return (
        f"{_core(s)}, e as materialized (select a, b from pr where a in (select id from core) and b in (select id from core)), "
        "cc(id, root) as (select id, id from core union select e.b, cc.root from cc join e on e.a = cc.id where cc.root < e.b), "
        "comp as materialized (select id, min(root) root from cc group by id)"
    )


def _labelled(s: Source) -> str:
    ks = ", ".join(f"k{i}" for i in range(s.dim))
    return (
        f"{_components(s)}, lab as (select root, (dense_rank() over (order by max(row({ks}))) - 1)::int label from comp join g using (id) group by root), "
        "bo as (select a id, b, row_number() over (partition by a order by d2, b) rn from pr where a not in (select id from core) and b in (select id from core)), "
        "res as (select p.id, coalesce(l1.label, l2.label, -1)::int label, c1.id is not null is_core from p left join comp c1 on c1.id = p.id left join lab l1 on l1.root = c1.root "
        "left join bo on bo.id = p.id and bo.rn = 1 left join comp c2 on c2.id = bo.b left join lab l2 on l2.root = c2.root)"
    )


def _clustered(s: Source):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = s.points(spark, sf_dir)
        return dbscan(points, [f"c{i}" for i in range(s.dim)], s.eps, s.least).select("id", "label", "is_core")

    return query, f"with recursive {_labelled(s)} select id, label, is_core from res"


def _stage(s: Source, name: str, columns: list[str]):
    """A stage's columns; those of a stage of places that are asked for by id, for every point."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stages = Stages(s.points(spark, sf_dir), s.eps, s.least)
        rows = getattr(stages, name).select(*columns)
        return stages.of_points(rows) if "id" in columns else rows

    return query


def _on(s: Source, make: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: make(s.points(spark, sf_dir))


def _celled(s: Source, make: Callable[[DataFrame, Extent], DataFrame]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = s.points(spark, sf_dir)
        box = extent(points)
        return make(grid.with_cells(points, box.low, grid.side_of(s.eps, s.dim)), box)

    return query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"), (F.col("o_orderstatus") == "F").alias("flag"))


_ORDERS = "o as (select o_orderkey id, round(o_totalprice * 100)::bigint v, o_orderstatus = 'F' flag from orders)"


def _query_points() -> dict[str, tuple[Callable, str]]:
    at, low, high, centre = [0.1, -0.05], [-0.1, -0.1], [0.1, 0.1], [0.0, 0.0]
    side2 = grid.side_of(E2.eps, 2)
    near = " or ".join(f"(b.k0-a.k0={o[0]} and b.k1-a.k1={o[1]})" for o in grid.offsets(2, 5))
    nation_boxes = "bx as (select k g, min(c0) l0, max(c0) h0, min(c1) l1, max(c1) h1 from (select *, id % 7 k from p) group by k)"

    def nation(spark, sf_dir):
        return boxes.bounding_box(E2.points(spark, sf_dir).withColumn("g", F.pmod("id", F.lit(7))), "g")

    def box_pairs(spark, sf_dir):
        one = nation(spark, sf_dir)
        return one.alias("a").join(one.alias("b"), F.col("a.g") < F.col("b.g"))

    def metric_query(spark, sf_dir, measure=metrics.contingency):
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").alias("truth"))
        labelled = dbscan(rows, "embedding", E2.eps, E2.least, "vec_id", dim=2)
        return measure(labelled, "truth", "label")

    gap = "greatest(a.l{i}-b.h{i}, b.l{i}-a.h{i}, 0.0::double)"
    gaps = "+".join(f"{gap.format(i=i)}*{gap.format(i=i)}" for i in (0, 1))
    span = "(greatest(a.h{i},b.h{i})-least(a.l{i},b.l{i}))"
    spans = "+".join(f"{span.format(i=i)}*{span.format(i=i)}" for i in (0, 1))
    diag = "sqrt(({t}.h0-{t}.l0)*({t}.h0-{t}.l0)+({t}.h1-{t}.l1)*({t}.h1-{t}.l1))"
    mid = "((a.l{i}+a.h{i})/2.0::double-(b.l{i}+b.h{i})/2.0::double)"
    mids = "+".join(f"{mid.format(i=i)}*{mid.format(i=i)}" for i in (0, 1))
    ends = "(a.h{i}-a.l{i})"

    return {
        # grid
        "min_corner": (_on(E2, grid.min_corner), f"with {E2.p} select min(c0) m0, min(c1) m1 from p"),
        "bounding_box": (_on(E3, boxes.bounding_box), f"with {E3.p} select min(c0) l0, min(c1) l1, min(c2) l2, max(c0) h0, max(c1) h1, max(c2) h2 from p"),
        "grid_assign": (_celled(E2, lambda g, b: g.select("id", "k0", "k1")), f"with {_cells(E2)} select id, k0, k1 from g"),
        "cell_counts": (_celled(CUSTOMER, lambda g, b: grid.cells(g)), f"with {_cells(CUSTOMER)} select k0, k1, count(*) n from g group by all"),
        "num_cells": (_celled(E3, lambda g, b: grid.cells(g).agg(F.count("*").alias("n"))), f"with {_cells(E3)} select count(*) n from (select distinct k0, k1, k2 from g)"),
        "dense_cells": (_celled(EVENTS, lambda g, b: grid.dense_cells(g, EVENTS.least)), f"with {_cells(EVENTS)} select k0, k1, count(*) n from g group by all having count(*) >= {EVENTS.least}"),
        "dense_cells_customer": (_celled(CUSTOMER, lambda g, b: grid.dense_cells(g, 3)), f"with {_cells(CUSTOMER)} select k0, k1, count(*) n from g group by all having count(*) >= 3"),
        "cell_centres": (_celled(E2, lambda g, b: grid.cell_centres(grid.cells(g), b.low, side2, 2)), f"with {_cells(E2)} select distinct k0, k1, {_num(side2 / 2)} + m0 + k0 * {_num(side2)} x0, {_num(side2 / 2)} + m1 + k1 * {_num(side2)} x1 from g, m"),
        "neighbour_cells": (_celled(E2, lambda g, b: grid.neighbour_cells(grid.cells(g), 2)), f"with {_cells(E2)}, c as (select distinct k0, k1 from g) select a.k0, a.k1, b.k0 q0, b.k1 q1 from c a join c b on {near}"),
        "neighbour_points": (_celled(E2, lambda g, b: grid.neighbour_points(g)), f"with {_cells(E2)}, c as (select distinct k0, k1 from g) select a.k0, a.k1, b.id from c a join g b on {near}"),
        "cell_at": (_celled(E2, lambda g, b: grid.cell_at(g, at, b.low, side2).select("id")), f"with {_cells(E2)} select id from g, m where k0 = floor(({_num(at[0])}-m0)/{_num(side2)})::bigint and k1 = floor(({_num(at[1])}-m1)/{_num(side2)})::bigint"),
        "cell_number": (_celled(E2, lambda g, b: grid.cell_number(grid.cells(g), 17, 2)), f"with {_cells(E2)} select k0, k1, count(*) n from g group by all order by k0, k1 limit 1 offset 17"),
        # joins by distance
        "eps_pairs": (lambda s, d: neighbors.eps_pairs(p := E2.points(s, d), extent(p), E2.eps), f"with {_pairs(E2)} select a, b, d2 from pr"),
        "eps_counts": (lambda s, d: neighbors.eps_counts(p := CUSTOMER.points(s, d), extent(p), CUSTOMER.eps), f"with {_pairs(CUSTOMER)} select a id, count(*) n from pr group by a"),
        "eps_pairs_5d": (lambda s, d: neighbors.eps_pairs(p := E5.points(s, d), extent(p), E5.eps), f"with {_pairs(E5)} select a, b, d2 from pr"),
        "range_query": (_on(E2, lambda p: neighbors.range_query(p, at, 0.1).select("id", "d2")), f"with {E2.p}, b as (select {_num(at[0])} c0, {_num(at[1])} c1) select p.id, {_d2(2, 'p')} d2 from p, b where {_d2(2, 'p')} <= {_num(0.1 * 0.1)}"),
        "box_query": (_on(E2, lambda p: neighbors.box_query(p, low, high).select("id")), f"with {E2.p} select id from p where c0 between -0.1::double and 0.1::double and c1 between -0.1::double and 0.1::double"),
        "knn": (
            lambda s, d: neighbors.knn(p := SUPPLIER.points(s, d), p, 4).select("id", "near", "d2", F.col("rank").cast("long").alias("rank")),
            f"with {SUPPLIER.p}, r as (select a.id, b.id near, {_d2(2)} d2, row_number() over (partition by a.id order by {_d2(2)}, b.id) as rank from p a, p b) select id, near, d2, rank from r where rank <= 4",
        ),
        "closest_pair": (
            lambda s, d: neighbors.closest_pair((p := SUPPLIER.points(s, d)).where("id % 2 = 0"), p.where("id % 2 = 1")),
            f"with {SUPPLIER.p}, r as (select a.id u, b.id v, {_d2(2)} d2 from p a, p b where a.id % 2 = 0 and b.id % 2 = 1) select u, v, d2 from r order by d2, u, v limit 1",
        ),
        "nearest_core": (
            lambda s, d: neighbors.nearest_within((t := Stages(E2.points(s, d), E2.eps, E2.least)).points.join(t.of_points(t.core.select("id")), "id", "left_anti"), t.core.select("id", "c0", "c1"), t.box, E2.eps),
            f"with {_core(E2)}, r as (select a id, b near, d2, row_number() over (partition by a order by d2, b) rn from pr where b in (select id from core)) select p.id, r.near, r.d2 from p left join r on r.id = p.id and rn = 1 where p.id not in (select id from core)",
        ),
        # stages
        "core_points": (_stage(CUSTOMER, "core", ["id"]), f"with {_core(CUSTOMER)} select id from core"),
        "core_cells": (_stage(E2, "core_cells", ["k0", "k1"]), f"with {_core(E2)} select distinct k0, k1 from g where id in (select id from core)"),
        "core_closest_pairs": (
            lambda s, d: neighbors.eps_join((t := Stages(E2.points(s, d), E2.eps, E2.least)).owned, t.owned, t.box, E2.eps).where("cell < r_cell").groupBy(F.least(F.struct("k0", "k1"), r := F.struct(F.col("r_k0").alias("k0"), F.col("r_k1").alias("k1"))).alias("x"), F.greatest(F.struct("k0", "k1"), r).alias("y")).agg(F.min("d2").alias("d2")).select("x.k0", "x.k1", F.col("y.k0").alias("q0"), F.col("y.k1").alias("q1"), "d2"),
            f"with {_core(E2)} select x.k0, x.k1, y.k0 q0, y.k1 q1, min(d2) d2 from pr join g x on x.id = a join g y on y.id = b where a in (select id from core) and b in (select id from core) and row(x.k0, x.k1) < row(y.k0, y.k1) group by all",
        ),
        "components": (
            lambda s, d: (t := Stages(E2.points(s, d), E2.eps, E2.least)).owned.join(t.components, "cell").groupBy("root").agg(F.min("id").alias("root_id"), F.sum("times").alias("n")).select("root_id", "n"),
            f"with recursive {_components(E2)} select root root_id, count(*) n from comp group by root",
        ),
        "core_labels": (_stage(E2B, "core_labels", ["id", "label"]), f"with recursive {_labelled(E2B)} select id, label from res where is_core"),
        "border_labels": (_stage(E2B, "border_labels", ["id", "label"]), f"with recursive {_labelled(E2B)} select id, label from res where not is_core and label >= 0"),
        "noise_points": (lambda s, d: Stages(E2.points(s, d), E2.eps, E2.least).labels.where("label < 0").select("id"), f"with recursive {_labelled(E2)} select id from res where label < 0"),
        "cluster_sizes": (lambda s, d: Stages(E2.points(s, d), E2.eps, E2.least).labels.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_core").alias("n_core")), f"with recursive {_labelled(E2)} select label, count(*) n, count_if(is_core)::bigint n_core from res group by label"),
        "cluster_counts": (lambda s, d: counts(_clustered(E2B)[0](s, d)), f"with recursive {_labelled(E2B)} select count(distinct label) filter (label >= 0) n_clusters, count(*) filter (label < 0) n_noise from res"),
        "estimator": (lambda s, d: SparkDBSCAN(eps=E2B.eps, min_samples=E2B.least).fit_predict(E2B.points(s, d)), f"with recursive {_labelled(E2B)} select id, label from res"),
        "core_components": (lambda s, d: SparkDBSCAN(eps=E2.eps, min_samples=E2.least).fit(E2.points(s, d)).components_, f"with {_core(E2)} select c0, c1 from p where id in (select id from core)"),
        "contingency": (metric_query, f"with recursive {_labelled(E2)} select e.label truth, res.label, count(*) n from res join embeddings e on e.vec_id = res.id group by all"),
        "agreement": (
            lambda s, d: metric_query(s, d, metrics.agreement).select(*[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v_measure", "adjusted_rand")]),
            f"with recursive {_labelled(E2)}, ct as (select e.label truth, res.label, count(*)::double n from res join embeddings e on e.vec_id = res.id group by all), "
            "ra as (select truth, sum(n) a from ct group by all), cb as (select label, sum(n) b from ct group by all), t as (select sum(n) t from ct), "
            "j as (select sum(-n/t*ln(n/b)) h_ck, sum(-n/t*ln(n/a)) h_kc, sum(n*(n-1)/2) i from ct join ra using (truth) join cb using (label), t), "
            "x as (select sum(-a/t*ln(a/t)) h_c, sum(a*(a-1)/2) sa from ra, t), y as (select sum(-b/t*ln(b/t)) h_k, sum(b*(b-1)/2) sb from cb, t), "
            "h as (select case when h_c=0 then 1 else 1-h_ck/h_c end ho, case when h_k=0 then 1 else 1-h_kc/h_k end co, sa*sb/(t*(t-1)/2) ex, (sa+sb)/2 mx, i from j, x, y, t) "
            "select round(ho, 9) homogeneity, round(co, 9) completeness, round(case when ho+co=0 then 0 else 2*ho*co/(ho+co) end, 9) v_measure, round(case when mx=ex then 1 else (i-ex)/(mx-ex) end, 9) adjusted_rand from h",
        ),
        "standard_scale": (_on(E2, lambda p: metrics.standard_scale(p, ["c0", "c1"]).select("id", F.round("c0", 9).alias("c0"), F.round("c1", 9).alias("c1"))), f"with {E2.p}, s as (select avg(c0) a0, stddev_pop(c0) s0, avg(c1) a1, stddev_pop(c1) s1 from p) select id, round((c0-a0)/s0, 9) c0, round((c1-a1)/s1, 9) c1 from p, s"),
        # graph
        "least_reachable": (
            lambda s, d: least_reachable(neighbors.eps_links(p := SUPPLIER.points(s, d), extent(p), 0.4)),
            f"with recursive {SUPPLIER.p}, e as materialized (select a.id a, b.id b from p a join p b on {_d2(2)} <= {_num(0.4 * 0.4)} and a.id <> b.id), cc(id, root) as (select a, a from e union select e.b, cc.root from cc join e on e.a = cc.id where cc.root < e.b) select id vertex, min(root) as label from cc group by id",
        ),
        "spanning_forest_size": (
            lambda s, d: spanning_forest(neighbors.eps_links(p := SUPPLIER.points(s, d), extent(p), 0.4)).agg(F.count("*").alias("n")),
            f"with recursive {SUPPLIER.p}, e as materialized (select a.id a, b.id b from p a join p b on {_d2(2)} <= {_num(0.4 * 0.4)} and a.id <> b.id), cc(id, root) as (select a, a from e union select e.b, cc.root from cc join e on e.a = cc.id where cc.root < e.b), l as (select id, min(root) root from cc group by id) select count(*) - count(distinct root) n from l",
        ),
        # scans over an order
        "prefix_sum": (lambda s, d: scans.prefix_sum(_orders(s, d), "v", "id", "x").select("id", "x"), f"with {_ORDERS} select id, coalesce(sum(v) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint x from o"),
        "scan_inclusive": (lambda s, d: scans.scan(_orders(s, d), "v", "id", "x", inclusive=True).select("id", "x"), f"with {_ORDERS} select id, (sum(v) over (order by id))::bigint x from o"),
        "scan_back": (lambda s, d: scans.scan(_orders(s, d), "v", "id", "x", backward=True).select("id", "x"), f"with {_ORDERS} select id, coalesce(sum(v) over (order by id desc rows between unbounded preceding and 1 preceding), 0)::bigint x from o"),
        "scan_inclusive_back": (lambda s, d: scans.scan(_orders(s, d), "v", "id", "x", inclusive=True, backward=True).select("id", "x"), f"with {_ORDERS} select id, (sum(v) over (order by id desc))::bigint x from o"),
        "enumerate_flags": (lambda s, d: scans.enumerate_flags(_orders(s, d), "flag", "id", "x").select("id", "x"), f"with {_ORDERS} select id, coalesce(sum(flag::int) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint x from o"),
        "pack": (lambda s, d: scans.enumerate_flags(_orders(s, d), "flag", "id", "x").where("flag").select("x", "v"), f"with {_ORDERS} select row_number() over (order by id) - 1 x, v from o where flag"),
        "pack_index": (lambda s, d: _orders(s, d).where("flag").select("id"), f"with {_ORDERS} select id from o where flag"),
        "pack_map": (lambda s, d: scans.enumerate_flags(_orders(s, d), "flag", "id", "x").where("flag").select("x", (F.col("v") * 2 + F.col("id")).alias("y")), f"with {_ORDERS} select row_number() over (order by id) - 1 x, v * 2 + id y from o where flag"),
        "pack_two": (
            lambda s, d: scans.pack_two(_orders(s, d), "flag", F.col("v") % 3 == 0, "id", "x").select("part", "x", "id"),
            f"with {_ORDERS} select 1 part, row_number() over (order by id) - 1 x, id from o where flag union all select 2, row_number() over (order by id) - 1, id from o where v % 3 = 0",
        ),
        "bit_flag_count": (lambda s, d: scans.bit_flags(_orders(s, d), "flag", "id").agg(F.sum(F.bit_count("bits")).alias("n"), F.count("*").alias("words")), f"with {_ORDERS} select count_if(flag)::bigint n, count(distinct id // 63) words from o"),
        "log2_up": (lambda s, d: _orders(s, d).select("id", scans.log2_up(F.col("v") % 5000).alias("x")), f"with {_ORDERS} select id, (case when v % 5000 <= 1 then 0 else length(bin(v % 5000 - 1)) end)::int x from o"),
        "split_stable": (lambda s, d: scans.split_stable(_orders(s, d), "flag", "id", "x").select("id", "x"), f"with {_ORDERS} select id, row_number() over (order by flag, id) - 1 x from o"),
        "arg_extremes": (
            lambda s, d: scans.arg_max(_orders(s, d).withColumn("w", F.col("v") % 97), "w", "id").withColumnRenamed("arg_max", "max_first").crossJoin(scans.arg_max(_orders(s, d).withColumn("w", F.col("v") % 97), "w", "id", last=True).withColumnRenamed("arg_max", "max_last")).crossJoin(scans.arg_min(_orders(s, d).withColumn("w", F.col("v") % 97), "w", "id").withColumnRenamed("arg_min", "min_first")),
            f"with {_ORDERS}, w as (select id, v % 97 w from o) select (select id from w order by w desc, id limit 1) max_first, (select id from w order by w desc, id desc limit 1) max_last, (select id from w order by w, id limit 1) min_first",
        ),
        "reduce_sum_count": (lambda s, d: _orders(s, d).agg(F.sum("v").alias("total"), F.count_if("flag").alias("flagged"), F.count_distinct("v").alias("different")), f"with {_ORDERS} select sum(v)::bigint total, count_if(flag)::bigint flagged, count(distinct v) different from o"),
        "dense_rank": (lambda s, d: scans.dense_rank_over(_orders(s, d).withColumn("w", F.col("v") % 1000), "w", "x").select("id", "x"), f"with {_ORDERS} select id, dense_rank() over (order by v % 1000) x from o"),
        "dedup_points": (_on(CUSTOMER, lambda p: p.groupBy(F.floor("c0").alias("x"), F.col("c1").alias("y")).agg(F.min("id").alias("id"))), f"with {CUSTOMER.p} select floor(c0)::bigint x, c1 y, min(id) id from p group by all"),
        "transpose": (lambda s, d: scans.transpose(_celled(CUSTOMER, lambda g, b: grid.cells(g))(s, d), "k0", "k1"), f"with {_cells(CUSTOMER)}, t as (select k0 a, k1 b, count(*) n from g group by all) select b k0, a k1, n from t"),
        # boxes and vectors
        "box_relation": (
            lambda s, d: box_pairs(s, d).select(F.col("a.g").alias("g"), F.col("b.g").alias("other"), boxes.relation(2).alias("relation")),
            f"with {E2.p}, {nation_boxes} select a.g, b.g other, case when a.l0<=b.l0 and b.h0<=a.h0 and a.l1<=b.l1 and b.h1<=a.h1 then 'include' when a.l0<=b.h0 and b.l0<=a.h0 and a.l1<=b.h1 and b.l1<=a.h1 then 'overlap' else 'exclude' end relation from bx a join bx b on a.g < b.g",
        ),
        "box_distances": (
            lambda s, d: box_pairs(s, d).select(F.col("a.g").alias("g"), F.col("b.g").alias("other"), boxes.box_distance(2).alias("near"), boxes.box_far_distance(2).alias("far"), boxes.well_separated(2).alias("apart"), boxes.diagonal(2).alias("diagonal"), boxes.longest_side(2).alias("longest")),
            f"with {E2.p}, {nation_boxes} select a.g, b.g other, sqrt({gaps}) near, sqrt({spans}) far, sqrt({mids}) - {diag.format(t='a')} / 2.0::double - {diag.format(t='b')} / 2.0::double >= 2.0::double * (greatest({diag.format(t='a')}, {diag.format(t='b')}) / 2.0::double) apart, {diag.format(t='a')} diagonal, greatest({ends.format(i=0)}, {ends.format(i=1)}) longest from bx a join bx b on a.g < b.g",
        ),
        "vector_arithmetic": (
            _on(
                E2,
                lambda p: p.select(
                    "id", V.subtract(c2 := V.columns(2), c2[::-1])[0].alias("less"), V.scale(c2, 3.0)[1].alias("scaled"), V.divide(c2, 4.0)[0].alias("divided"), V.multiply(c2, c2[::-1])[0].alias("product"), V.min_coords(c2, c2[::-1])[0].alias("low"), V.max_coords(c2, c2[::-1])[1].alias("high"), V.same(c2, c2[::-1]).alias("same"), V.shown([F.col("id"), F.col("id") + 1]).alias("shown")
                ),
            ),
            f"with {E2.p} select id, c0-c1 less, c1*3.0::double scaled, c0/4.0::double divided, c0*c1 product, least(c0, c1) low, greatest(c0, c1) high, c0 = c1 as same, id || ' ' || (id + 1) shown from p",
        ),
        "vector_functions": (
            _on(E2, lambda p: p.select("id", V.dot(c2 := V.columns(2), c2).alias("dot"), V.dist(c2, [F.lit(0.5), F.lit(0.25)]).alias("dist"), V.normalize(c2)[0].alias("unit"), V.midpoint(c2, [F.lit(1.0), F.lit(1.0)])[1].alias("mid"), V.orthant(c2, centre).alias("orthant"), V.out_of_box(c2, centre, 0.1).alias("out"))),
            f"with {E2.p} select id, c0*c0+c1*c1 dot, sqrt((c0-0.5::double)*(c0-0.5::double)+(c1-0.25::double)*(c1-0.25::double)) dist, c0/sqrt(c0*c0+c1*c1) unit, (c1+1.0::double)/2 mid, (case when c0>0 then 1 else 0 end + case when c1>0 then 2 else 0 end)::int orthant, (c0<-0.1::double or c0>0.1::double) or (c1<-0.1::double or c1>0.1::double) as out from p",
        ),
    }


def all_queries() -> dict[str, tuple[Callable, str]]:
    clusters = {"dbscan_2d": E2, "dbscan_2d_tight": E2B, "dbscan_3d": E3, "dbscan_5d": E5, "dbscan_customer": CUSTOMER, "dbscan_events": EVENTS, "dbscan_supplier": SUPPLIER}
    return {name: _clustered(source) for name, source in clusters.items()} | _query_points()


QUERIES = {name: query for name, (query, _) in all_queries().items()}
ORACLE_SQL = {name: sql for name, (_, sql) in all_queries().items()}
