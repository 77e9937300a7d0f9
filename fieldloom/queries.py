"""The matrix engine's queries by name, with equivalent SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import field
from fieldloom.functions.field import PRIME as P
from fieldloom.operators import benchlog, echelon, eliminate, layout, recursive, verify
from fieldloom.operators.multiply import multiply_cells, multiply_exact, multiply_rows, multiply_tiles
from fieldloom.operators.symmetric import gram_cells, gram_tiles
from fieldloom.plans import runs
from fieldloom.plans.cuts import cut, fresh_path
from fieldloom.sources import benchlog as logs
from fieldloom.sources import matrices
from fieldloom.streaming import bases

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantised vectors, one a row."""
    return matrices.from_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spread over the full range of 32-bit words."""
    return _vectors(spark, sf_dir).withColumn("v", (F.col("v") * 65537 + 4294000000) % field.WORD)


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all vectors of the products of every two of their components, mod p."""
    n, m = _size(spark, sf_dir)
    t = layout.transpose(_vectors(spark, sf_dir))
    return multiply_tiles(t, t, m, m, n)


def _buckets(spark: SparkSession, sf_dir: str, rows: int, columns: int) -> DataFrame:
    """Quantities of all line items by order and part bucket, mod p."""
    return matrices.from_pairs(_table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % rows, F.col("l_partkey") % columns, F.col("l_quantity"))


def _size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    r = _table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("n"), F.max(F.size("embedding")).alias("m")).first()
    return int(r["n"]) + 1, int(r["m"])


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = _size(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    return multiply_tiles(v, v, n, n, m)


def gram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors times the matrix of their moments."""
    return multiply_rows(_vectors(spark, sf_dir), _moments(spark, sf_dir))


def gram_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = _size(spark, sf_dir)
    wide = _wide(spark, sf_dir)
    return multiply_tiles(wide, wide, n, n, m, p=None)


def gram_u32_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = layout.transpose(_wide(spark, sf_dir))
    return multiply_cells(wide, wide, None)


def _incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of all line items by supplier and part, mod p."""
    return matrices.from_pairs(_table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_quantity"))


def cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_cells(_incidence(spark, sf_dir))


def mat_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.transpose(_vectors(spark, sf_dir))


def _suppliers(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "supplier").count()


def mat_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as suppliers."""
    return matrices.deterministic(spark, _suppliers(spark, sf_dir), 80)


def mat_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balances of customer buckets and nations, with a border up to whole tiles."""
    return matrices.padded(_balances(spark, sf_dir), 60, 25, 16)


def mat_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the three random generators, a row for each supplier."""
    n = _suppliers(spark, sf_dir)
    made = [("words", matrices.random_words(spark, n, 30, 1)), ("small", matrices.random_small(spark, n, 30, 2)), ("field", matrices.random_field(spark, n, 30, P, 3))]
    rows = [m.select(F.lit(name).alias("kind"), "i", "j", "v") for name, m in made]
    return rows[0].union(rows[1]).union(rows[2])


def mat_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into tiles and back."""
    n, m = _size(spark, sf_dir)
    return layout.TileMatrix.of(_vectors(spark, sf_dir), n, m, 48).cells()


def neg_inverse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every part number, mod a small and a large prime; multiples have none."""
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("a"))
    made = [parts.select("a", F.lit(p).cast("long").alias("p"), field.neg_inverse_col("a", p).alias("ninv")) for p in (251, P)]
    return made[0].union(made[1])


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prices of all orders by month and customer bucket, mod p."""
    return matrices.from_pairs(_table(spark, sf_dir, "orders"), F.month("o_orderdate") - 1, F.col("o_custkey") % 12, F.floor("o_totalprice"))


def lu_packed_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliminate.eliminate(_months(spark, sf_dir), 12, 12)


def lu_upper_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.upper(eliminate.eliminate_fold(_months(spark, sf_dir), 12, 12, full=False))


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole balances of all customers by customer bucket and nation, mod p, and a diagonal: many cells are absent."""
    t = _table(spark, sf_dir, "customer")
    a = matrices.from_pairs(t, F.col("c_custkey") % 60, F.col("c_nationkey"), F.pmod(F.floor("c_acctbal"), F.lit(P).cast("long")))
    return a.unionByName(spark.range(25).select(F.col("id").alias("i"), F.col("id").alias("j"), (F.col("id") * 7 + 12345).alias("v"))).groupBy("i", "j").agg((F.sum("v") % P).alias("v"))


def lu_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix with absent cells in four forms."""
    m = _balances(spark, sf_dir)
    small = m.where("i < 40")
    made = {
        "fold": eliminate.eliminate_fold(small, 40, 25), "halves": eliminate.eliminate_by_halves(m, 60, 25, leaf=4), "strip": eliminate.eliminate_strip(m, 60, 25, block_bytes=2048),
        "tiles": eliminate.eliminate_tiles(m, 60, 25, tile=16), "rows": eliminate.eliminate_by_rows(small.where("j < 12"), 40, 12),
    }
    parts = [df.withColumn("form", F.lit(name)) for name, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def lu_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of matrices that cannot be eliminated: the first pivot that fails, of nations by suppliers and of suppliers by suppliers."""
    t, n = _table(spark, sf_dir, "supplier"), _suppliers(spark, sf_dir)
    made = {
        "nations": (matrices.from_pairs(t, F.col("s_nationkey"), F.col("s_suppkey") % 25, F.lit(1)), 25, 25),
        "suppliers": (matrices.from_pairs(t, F.col("s_suppkey"), F.pmod(F.col("s_suppkey") * 7 + F.col("s_nationkey"), F.lit(n)), F.lit(1)), n, n),
    }
    within = lambda m, rows, columns: (m.where(f"i between 0 and {rows - 1} and j between 0 and {columns - 1}"), rows, columns)  # noqa: E731  keys may have gaps
    rows = [eliminate.eliminate_with_status(*within(*m)).select(F.lit(name).alias("matrix"), "singular_at").distinct() for name, m in made.items()]
    return rows[0].union(rows[1])


def lu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliminate.eliminate_by_rows(_buckets(spark, sf_dir, 12, 12), 12, 12)


def lu_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliminate.eliminate_fold(_buckets(spark, sf_dir, 16, 16), 16, 16)


def lu_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _size(spark, sf_dir)
    return eliminate.eliminate_by_halves(_moments(spark, sf_dir), m, m, leaf=4)


def lu_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _size(spark, sf_dir)
    return eliminate.eliminate_tiles(_moments(spark, sf_dir), m, m, tile=24)


def lu_any_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form chosen by size: all vectors, and the buckets of line items."""
    n, m = _size(spark, sf_dir)
    whole = eliminate.eliminate(_vectors(spark, sf_dir), n, m).withColumn("part", F.lit("vectors"))
    return whole.unionByName(eliminate.eliminate(_buckets(spark, sf_dir, 12, 16), 12, 16).withColumn("part", F.lit("buckets")))


def lu_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = _size(spark, sf_dir)
    return eliminate.eliminate_tiles(layout.transpose(_vectors(spark, sf_dir)), m, n, tile=64)


def lu_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one matrix."""
    n, m = _size(spark, sf_dir)
    return eliminate.eliminate_tiles(_vectors(spark, sf_dir), n, m, tile=64)


def lu_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of each label's vectors in eight sums of components, factored label by label."""
    t = _table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("j", "x"), "vec_id")
    t = t.groupBy("label", "vec_id", (F.col("j") % 8).cast("long").alias("j")).agg((F.sum(F.pmod(F.floor(F.col("x").cast("double") * 1000), F.lit(P).cast("long"))) % P).alias("v"))
    pairs = t.join(t.select("label", "vec_id", F.col("j").alias("i"), F.col("v").alias("w")), ["label", "vec_id"])
    return eliminate.eliminate_groups(pairs.groupBy("label", "i", "j").agg((F.sum(F.col("v") * F.col("w")) % P).alias("v")), ["label"])


def _supply(spark: SparkSession, sf_dir: str, parts: int) -> tuple[layout.TileMatrix, layout.TileMatrix, int]:
    """Common parts of every two suppliers, by quantities, mod p, as written tiles, ``parts`` of them a side at least; the same with a diagonal; and the number of suppliers.

    The product is made as tiles: none of its cells is written or shuffled.
    """
    n = _suppliers(spark, sf_dir)
    common = gram_tiles(_incidence(spark, sf_dir), n, min(max(8, -(-n // parts)), recursive.LARGEST_TILE))
    common = replace(common, df=cut(common.df, "common"))
    return common, common.plus_diagonal(lambda i: i * 7 + 12345, P), n


def lu_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m, n = _supply(spark, sf_dir, 4)
    return recursive.eliminate_recursive(m, n, n)


def solve_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinations of the moments' columns that give each vector."""
    n, m = _size(spark, sf_dir)
    return recursive.solve(_moments(spark, sf_dir), m, layout.transpose(_vectors(spark, sf_dir)), n, tile=24)


def inverse_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m, n = _supply(spark, sf_dir, 2)
    return recursive.invert(m, n)


def det_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The determinants of the moments' diagonal tiles after elimination; their product is the moments'."""
    _, m = _size(spark, sf_dir)
    return recursive.determinants(recursive.factor(_moments(spark, sf_dir), m, m, tile=24))


ORDER_COLUMNS = 13


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every customer with orders: their number by priority (5) and status (3) and in all, their whole price in all and by status (3). Three columns depend on others."""
    t = _table(spark, sf_dir, "orders")
    one, price = F.lit(1).cast("long"), F.floor("o_totalprice")
    status = F.expr("cast(locate(o_orderstatus, 'FOP') - 1 as bigint)")
    entries = F.array(*(F.struct(j.cast("long").alias("j"), v.alias("v")) for j, v in ((F.substring("o_orderpriority", 1, 1).cast("long") - 1, one), (status + 5, one), (F.lit(8), one), (F.lit(9), price), (status + 10, price))))
    cells = t.select(F.col("o_custkey").cast("long").alias("i"), F.explode(entries).alias("e"))
    return cells.groupBy("i", F.col("e.j").alias("j")).agg((F.sum("e.v") % P).alias("v"))


def reduced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced echelon form of the customers' orders: which columns are independent, and how the others depend on them."""
    return echelon.reduced(_orders(spark, sf_dir), ORDER_COLUMNS).select("r", "pivot_j", "i", F.posexplode("v").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def independent_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customers whose orders are no combination of those of customers before them."""
    return echelon.independent_rows(_orders(spark, sf_dir), ORDER_COLUMNS).select("i")


def pluq_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' orders factored with pivots, rows and columns permuted."""
    rows = _table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] + 1
    return echelon.pluq(_orders(spark, sf_dir), rows, ORDER_COLUMNS)[2]


def stream_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each label's vectors are independent, kept up by a stream over the table's files."""
    path, out = f"{sf_dir}/embeddings.parquet", fresh_path(spark, "ranks")
    _, m = _size(spark, sf_dir)
    new = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since a stream takes no single file
    whole = new.select("label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("x"))
    bases.ranks_to(bases.ranks(whole, "label", "x", m), f"{out}/ranks", f"{out}/checkpoint")
    return bases.latest(spark, f"{out}/ranks", "label")


def check_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies on the same input, by the upper triangle."""
    m = _buckets(spark, sf_dir, 16, 16)
    return verify.compare(eliminate.eliminate_tiles(m, 16, 16, tile=6), eliminate.eliminate_fold(m, 16, 16, full=False))


def check_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(I - N) U against the matrix that was factored."""
    n, m = _size(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    back = verify.rebuilt(eliminate.eliminate_tiles(v, n, m, tile=64), n, m)
    return verify.compare(v.where("v <> 0"), back.where("v <> 0"), upper_only=False).select("mismatching")


def check_probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random vectors against the factors of the suppliers' matrix, against those with one cell changed, and against a product."""
    a, (common, m, n) = _incidence(spark, sf_dir).where("i is not null"), _supply(spark, sf_dir, 2)
    packed = recursive.factor(m, n, n)
    made = {"factors": verify.probably_factored(packed, m), "changed": verify.probably_factored(packed.with_added(3, 7, 1), m), "product": verify.probably_product(a, a, common)}
    rows = [df.select(F.lit(name).alias("form"), "compared", "failing") for name, df in made.items()]
    return rows[0].union(rows[1]).union(rows[2])


def _order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of large multiples of all order keys by customer bucket and week of the year, of either sign."""
    t = _table(spark, sf_dir, "orders")
    v = (F.col("o_orderkey") + 1) * F.lit(1000003).cast("long") * F.when(F.col("o_custkey") % 3 == 0, -1).otherwise(1)
    return t.groupBy((F.col("o_custkey") % 40).cast("long").alias("i"), F.weekofyear("o_orderdate").cast("long").alias("j")).agg(F.sum(v).alias("v"))


def exact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact inner products beyond 64 bits, as text, and the same mod 2**64."""
    a = _order_keys(spark, sf_dir)
    whole = multiply_exact(a, a, 40, 40, 54).withColumn("v", F.col("v").cast("string"))
    return whole.join(multiply_exact(a, a, 40, 40, 54, wrap=True).withColumnRenamed("v", "word"), ["i", "j"])


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, rows, columns): customers and suppliers of each nation that has both."""
    customers = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("rows"))
    suppliers = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("columns"))
    return customers.join(suppliers, "nation")


def elimination_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on a matrix of each nation's customers by suppliers."""
    work = F.expr(field.elimination_flops_expr("rows", "columns"))
    return _nations(spark, sf_dir).select("nation", "rows", "columns", work.alias("elimination"), (2 * F.col("rows") * F.col("columns") * F.col("columns")).alias("multiplication"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's events as the reports of a benchmark: by kind of event (the method) and hour (the threads), least and greatest value (real and CPU seconds) and how many."""
    usable = _table(spark, sf_dir, "events").where("event_type is not null and ts is not null and value > 0")
    keys = [F.to_date("ts").cast("string").alias("file"), F.col("event_type").alias("method"), (F.hour("ts") + 1).alias("threads")]
    made = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.min("value").alias("real_s"), F.max("value").alias("cpu_s"))
    return made.withColumns({"chunk": F.lit(1), "gflops": F.when(F.col("runs") > 1, F.lit(2.0 * 1000**3 / 3e9) / F.col("real_s"))})


#: The kinds of events, which the logs' labels name (fixed values of the table).
EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports written as text logs, a file a day, and read back."""
    path = fresh_path(spark, "logs")
    logs.write_logs(_reports(spark, sf_dir), path)
    return logs.read_logs(spark, path)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.parse(_log_lines(spark, sf_dir), EVENT_KINDS)


def bench_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


def bench_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.header(_log_lines(spark, sf_dir)).select("file", F.posexplode("threads").alias("k", "threads"))


def bench_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.series(_records(spark, sf_dir)).select("file", "method", F.posexplode("times").alias("k", "real_s"))


def speedup_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.speedup_global(_records(spark, sf_dir))


def speedup_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.speedup_own(_records(spark, sf_dir))


def bench_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.throughput(_records(spark, sf_dir), 1000)


def bench_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from names of result folders, one for each nation's sizes, every other one of a growing run."""
    name = F.format_string("bench-mat-gep-%s%d-%d-%d-x", F.when(F.col("nation") % 2 == 1, "inc-").otherwise(""), "rows", "columns", F.col("nation") + 1)
    return benchlog.path_parameters(_nations(spark, sf_dir).select(name.alias("path")))


def bench_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.rates(_records(spark, sf_dir), 4096, 4096, 43)


def bench_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what their files' heads say."""
    lines = _log_lines(spark, sf_dir)
    heads = logs.header(lines).select("file", F.col("dims")[0].alias("runs"), F.col("dims")[1].alias("reports"), F.size("threads").alias("settings"))
    return benchlog.parse(lines, EVENT_KINDS).join(heads, "file")


def tile_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles down and across for each nation's sizes and some cache sizes."""
    every = _nations(spark, sf_dir).withColumn("level1", F.explode(F.array(*(F.lit(x).cast("long") for x in (32768, 49152, 65536)))))
    every = every.withColumn("tile", field.cache_tile_col("level1"))
    return every.withColumns({"down": F.ceil(F.col("rows") / F.col("tile")), "across": F.ceil(F.col("columns") / F.col("tile"))})


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_matrix_of(_reports(spark, sf_dir))


def bench_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _nations(spark, sf_dir)
    return runs.sweep_of(sizes, 100, 10).withColumn("kind", F.lit("added")).unionByName(runs.sweep_of(sizes, 0, 4).withColumn("kind", F.lit("doubled")))


_VECTORS = f"SELECT vec_id AS i, k - 1 AS j, CAST((CAST(floor(CAST(embedding[k] AS DOUBLE) * 1000) AS BIGINT) % {P} + {P}) % {P} AS BIGINT) AS v FROM embeddings, LATERAL unnest(range(1, len(embedding) + 1)) AS u(k)"
_WIDE = f"SELECT i, j, (v * 65537 + 4294000000) % 4294967296 AS v FROM ({_VECTORS})"
_DETERMINISTIC = "SELECT i, j, CASE WHEN j = i + 1 THEN 0 ELSE ((j - {m} + {l} + i - 17 + 4294967296) % 4294967296) % 65521 END AS v FROM range({l}) a(i), range({m}) b(j)"
_BITS = ", ".join(bin(P - 2)[2:])


def _inverse(a: str, p: str, bits: str) -> str:
    """SQL: p minus the inverse of a mod p, by the bits of p - 2."""
    return f"{p} - list_reduce(list_prepend(CAST(1 AS BIGINT), [{bits}]::BIGINT[]), lambda s, b: s * s % {p} * (CASE WHEN b = 1 THEN {a} % {p} ELSE 1 END) % {p})"


def elimination_sql(cells: str, pivots: str, where: str = "true", select: str = "r AS i, CAST(k - 1 AS BIGINT) AS j, v[k] AS v", group: str = "") -> str:
    """SQL: the packed form of a cells query, one step a recursion; ``group``: a column that keeps matrices apart."""
    g, over = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    return f"""
WITH RECURSIVE c AS ({cells}),
e AS (
  SELECT {g}CAST(0 AS BIGINT) AS step, i AS r, list(CAST(v AS BIGINT) ORDER BY j) AS v FROM c GROUP BY {g}i
  UNION ALL
  SELECT {g}step + 1, r, CASE WHEN r <= step THEN v ELSE list_transform(v, lambda x, k: CASE WHEN k - 1 < step THEN x WHEN k - 1 = step THEN m ELSE (x + pv[k] * m) % {P} END) END
  FROM (SELECT *, v[step + 1] * ({_inverse('pv[step + 1]', str(P), _BITS)}) % {P} AS m FROM (SELECT *, max(CASE WHEN r = step THEN v END) OVER ({over}) AS pv FROM e WHERE step < {pivots})))
SELECT {g}{select} FROM e, LATERAL unnest(range(1, len(v) + 1)) AS u(k) WHERE step = {pivots} AND {where}"""


_PER_LABEL = f"WITH t AS (SELECT label, vec_id, j % 8 AS j, sum(v) % {P} AS v FROM ({_VECTORS}) JOIN (SELECT vec_id, label FROM embeddings) ON i = vec_id GROUP BY label, vec_id, j % 8) SELECT a.label, a.j AS i, b.j, CAST(sum(a.v * b.v) % {P} AS BIGINT) AS v FROM t a JOIN t b USING (vec_id) GROUP BY a.label, a.j, b.j"
_MOMENTS = f"SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) % {P} AS BIGINT) AS v FROM ({_VECTORS}) a JOIN ({_VECTORS}) b ON a.i = b.i GROUP BY a.j, b.j"
_BUCKETS = f"SELECT l_orderkey % {{r}} AS i, l_partkey % {{c}} AS j, CAST(sum(CAST(l_quantity AS BIGINT)) % {P} AS BIGINT) AS v FROM lineitem GROUP BY 1, 2"
_LOG_SQL = f"""(
  WITH best AS (SELECT strftime(ts, '%Y-%m-%d') AS file, event_type AS method, CAST(hour(ts) + 1 AS INT) AS threads, CAST(1 AS INT) AS chunk, min(value) AS real_s, max(value) AS cpu_s, count(*) AS runs
                FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value > 0 GROUP BY ALL)
  SELECT file, CAST(row_number() OVER (PARTITION BY file, method ORDER BY threads) - 1 AS INT) AS seq, method, threads, chunk, real_s, cpu_s, CASE WHEN cpu_s > 1e-10 THEN cpu_s / real_s END AS ratio,
         CASE WHEN runs > 1 THEN CAST({2.0 * 1000**3 / 3e9!r} AS DOUBLE) / real_s ELSE -1 END AS gflops, runs FROM best)"""
_NATIONS_SQL = "(SELECT c_nationkey AS nation, rows, columns FROM (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS rows FROM customer GROUP BY 1) JOIN (SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, count(*) AS columns FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey)"
_WORK = f"SELECT nation, m AS rows, n AS columns, CAST((SELECT sum((2 * (n - i) + 11) * (m - i) + 10 * (n - i) * (m - i)) FROM range(1, 100000) r(i) WHERE i <= least(m, n)) AS BIGINT) AS elimination, 2 * m * n * n AS multiplication FROM (SELECT nation, rows AS m, columns AS n FROM {_NATIONS_SQL})"
_MONTHS = f"SELECT month(o_orderdate) - 1 AS i, o_custkey % 12 AS j, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % {P} AS BIGINT) AS v FROM orders GROUP BY 1, 2"


def _first_failure(cells: str, n: str) -> str:
    """SQL: the first pivot of an n x n matrix that is zero above something, or null."""
    return f"""
WITH RECURSIVE c AS ({cells}),
e AS (
  SELECT CAST(0 AS BIGINT) AS step, i AS r, list(CAST(v AS BIGINT) ORDER BY j) AS v FROM c GROUP BY i
  UNION ALL
  SELECT step + 1, r, CASE WHEN r <= step OR v[step + 1] = 0 THEN v ELSE list_transform(v, lambda x, k: CASE WHEN k - 1 < step THEN x WHEN k - 1 = step THEN m ELSE (x + pv[k] * m) % {P} END) END
  FROM (SELECT *, v[step + 1] * ({_inverse('pv[step + 1]', str(P), _BITS)}) % {P} AS m FROM (SELECT *, max(CASE WHEN r = step THEN v END) OVER () AS pv FROM e WHERE step < {n}))
  WHERE NOT (pv[step + 1] = 0 AND r > step AND v[step + 1] <> 0))
SELECT min(step) AS singular_at FROM (SELECT step, max(CASE WHEN r = step THEN v[step + 1] END) AS p, max(CASE WHEN r > step THEN v[step + 1] END) AS below FROM e WHERE step < {n} GROUP BY step) WHERE p = 0 AND below <> 0"""


def _dense(cells: str, rows: str, columns: str) -> str:
    return f"SELECT a.i, b.j, coalesce(c.v, 0) AS v FROM range({rows}) a(i) CROSS JOIN range({columns}) b(j) LEFT JOIN ({cells}) c ON c.i = a.i AND c.j = b.j"


def reduced_sql(cells: str, steps: str, group: str = "") -> str:
    """SQL: (r, pivot_j, i, v list) of the reduced echelon form of a query of all cells, with pivots in its first ``steps`` columns; ``group``: a column that keeps matrices apart."""
    g, over = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    return f"""
WITH RECURSIVE c AS ({cells}),
e AS (
  SELECT {g}CAST(0 AS BIGINT) AS step, i AS r, list(CAST(v AS BIGINT) ORDER BY j) AS v, CAST(NULL AS BIGINT) AS pivot_j FROM c GROUP BY {g}i
  UNION ALL
  SELECT {g}step + 1, r, CASE WHEN pr IS NULL THEN v WHEN r = pr THEN list_transform(v, lambda x: x * inv % {P}) ELSE list_transform(v, lambda x, k: (x + pv[k] * ({P} - v[step + 1] * inv % {P})) % {P}) END, CASE WHEN r = pr THEN step ELSE pivot_j END AS pivot_j
  FROM (SELECT *, ({P} - ({_inverse('pv[step + 1]', str(P), _BITS)})) % {P} AS inv FROM (SELECT *, max(CASE WHEN r = pr THEN v END) OVER ({over}) AS pv FROM (SELECT *, min(CASE WHEN pivot_j IS NULL AND v[step + 1] <> 0 THEN r END) OVER ({over}) AS pr FROM e WHERE step < {steps}))))
SELECT {g}row_number() OVER ({over} ORDER BY pivot_j) - 1 AS r, pivot_j, r AS i, v FROM e WHERE step = {steps} AND pivot_j IS NOT NULL"""


def _product(a: str, b: str, mod: int, on: str = "true") -> str:
    return f"WITH a AS ({a}), b AS ({b}) SELECT a.i AS i, b.i AS j, CAST(sum(CAST(a.v AS HUGEINT) * b.v) % {mod} AS BIGINT) AS v FROM a JOIN b ON a.j = b.j AND {on} GROUP BY a.i, b.i"


def _random(seed: int) -> str:
    x = f"((i * 1664525 + j * 22695477 + {seed * 40503 + 12345}) % {matrices.MODULUS})"
    for m in matrices.MULTIPLIERS:
        x = f"(xor({x}, {x} >> 15) % {matrices.MODULUS} * {m} % {matrices.MODULUS})"
    return x


def _sparse(form: str, rows: int, columns: int, pivots: int) -> str:
    return f"SELECT *, '{form}' AS form FROM ({elimination_sql(_BALANCES.format(rows=rows, columns=columns), str(pivots))})"


_BALANCES = f"""
  SELECT a.i, b.j, coalesce(c.v, 0) AS v FROM range({{rows}}) a(i) CROSS JOIN range({{columns}}) b(j) LEFT JOIN (
    SELECT i, j, CAST(sum(v) % {P} AS BIGINT) AS v FROM (
      SELECT c_custkey % 60 AS i, c_nationkey AS j, CAST(sum((CAST(floor(c_acctbal) AS BIGINT) % {P} + {P}) % {P}) % {P} AS BIGINT) AS v FROM customer GROUP BY 1, 2
      UNION ALL SELECT i, i, i * 7 + 12345 FROM range(25) d(i)) GROUP BY i, j) c ON c.i = a.i AND c.j = b.j"""
_BALANCES_FOUND = _BALANCES[_BALANCES.index("LEFT JOIN (") + 11 : _BALANCES.rindex(") c ON")]
_INCIDENCE = f"SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(CAST(l_quantity AS BIGINT)) % {P} AS BIGINT) AS v FROM lineitem GROUP BY 1, 2"
_SUPPLY = f"""
  SELECT a.i, b.j, CAST(coalesce(c.v, 0) AS BIGINT) AS v FROM (SELECT s_suppkey AS i FROM supplier) a CROSS JOIN (SELECT s_suppkey AS j FROM supplier) b LEFT JOIN (
    SELECT i, j, sum(v) % {P} AS v FROM (({_product(_INCIDENCE, _INCIDENCE, P)}) UNION ALL SELECT s_suppkey, s_suppkey, s_suppkey * 7 + 12345 FROM supplier) GROUP BY i, j) c ON c.i = a.i AND c.j = b.j"""
_SUPPLIERS = "(SELECT count(*) FROM supplier)"
_ORDER_CELLS = f"""
  SELECT a.i, b.j, coalesce(c.v, 0) AS v FROM ({{rows}}) a(i) CROSS JOIN range({ORDER_COLUMNS}) b(j) LEFT JOIN (
    SELECT o_custkey AS i, j, CAST(sum(v) % {P} AS BIGINT) AS v FROM (
      SELECT o_custkey, CAST(o_orderpriority[1] AS BIGINT) - 1 AS j, 1 AS v FROM orders UNION ALL SELECT o_custkey, instr('FOP', o_orderstatus) + 4, 1 FROM orders UNION ALL SELECT o_custkey, 8, 1 FROM orders
      UNION ALL SELECT o_custkey, 9, CAST(floor(o_totalprice) AS BIGINT) FROM orders UNION ALL SELECT o_custkey, instr('FOP', o_orderstatus) + 9, CAST(floor(o_totalprice) AS BIGINT) FROM orders) GROUP BY 1, 2) c ON c.i = a.i AND c.j = b.j"""
_ORDERS = _ORDER_CELLS.format(rows="SELECT DISTINCT o_custkey FROM orders")
_PERMUTED = f"""
  WITH f AS ({reduced_sql(_ORDERS, str(ORDER_COLUMNS))}), n AS (SELECT count(*) AS n, list(i) AS is, list(pivot_j) AS js FROM f), a AS ({_ORDER_CELLS.format(rows="SELECT * FROM range((SELECT max(c_custkey) + 1 FROM customer))")})
  SELECT coalesce(fi.r, a.i - len(list_filter(n.is, lambda x: x < a.i)) + n.n) AS i, coalesce(fj.r, a.j - len(list_filter(n.js, lambda x: x < a.j)) + n.n) AS j, a.v
  FROM a CROSS JOIN n LEFT JOIN f fi ON fi.i = a.i LEFT JOIN f fj ON fj.pivot_j = a.j"""

QUERIES = {
    f.__name__: f
    for f in (
        gram_matrix, gram_rows, gram_u32, gram_u32_cells, cross_product, mat_transpose, mat_deterministic, mat_padded, mat_random, mat_tiles, neg_inverse_table,
        lu_packed_12, lu_upper_12, lu_rows, lu_fold, lu_halves, lu_moments, lu_any_size, lu_wide, lu_tall, lu_per_label, lu_sparse, lu_recursive, solve_moments, inverse_supply, det_moments, reduced_orders, independent_customers, pluq_orders, stream_ranks, lu_status, check_mismatch, check_identity, check_probable, exact_orders,
        elimination_work, bench_records, bench_header, bench_series, speedup_global, speedup_own, bench_throughput, bench_rates, bench_files, tile_plans, bench_paths, bench_runs, bench_sizes,
    )
}
ORACLES = {
    "gram_matrix": _product(_VECTORS, _VECTORS, P),
    "gram_rows": _product(_VECTORS, _MOMENTS, P),
    "gram_u32": _product(_WIDE, _WIDE, field.WORD),
    "gram_u32_cells": _product(f"SELECT j AS i, i AS j, v FROM ({_WIDE})", f"SELECT j AS i, i AS j, v FROM ({_WIDE})", field.WORD),
    "cross_product": _product(_INCIDENCE, _INCIDENCE, P),
    "mat_transpose": f"SELECT j AS i, i AS j, v FROM ({_VECTORS})",
    "mat_deterministic": _DETERMINISTIC.format(l=_SUPPLIERS, m=80),
    "mat_padded": f"SELECT a.i, b.j, coalesce(d.v, CASE WHEN a.i = b.j AND (a.i >= 60 OR b.j >= 25) THEN 1 WHEN a.i >= 60 OR b.j >= 25 THEN 0 END) AS v FROM range(64) a(i) CROSS JOIN range(32) b(j) LEFT JOIN ({_BALANCES_FOUND}) d ON d.i = a.i AND d.j = b.j WHERE a.i >= 60 OR b.j >= 25 OR d.v IS NOT NULL",
    "mat_random": " UNION ALL ".join(f"SELECT '{kind}' AS kind, i, j, {_random(seed)} % {bound} AS v FROM range({_SUPPLIERS}) a(i), range(30) b(j)" for kind, seed, bound in (("words", 1, 1 << 31), ("small", 2, 20), ("field", 3, P))),
    "mat_tiles": _VECTORS,
    "neg_inverse_table": f"SELECT a, CAST(251 AS BIGINT) AS p, CASE WHEN a % 251 <> 0 THEN {_inverse('a', '251', ', '.join(bin(249)[2:]))} END AS ninv FROM (SELECT CAST(p_partkey AS BIGINT) AS a FROM part) UNION ALL SELECT a, CAST({P} AS BIGINT), CASE WHEN a % {P} <> 0 THEN {_inverse('a', str(P), _BITS)} END FROM (SELECT CAST(p_partkey AS BIGINT) AS a FROM part)",
    "lu_packed_12": elimination_sql(_MONTHS, "11"),
    "lu_upper_12": elimination_sql(_MONTHS, "11", "k - 1 >= r"),
    "lu_rows": elimination_sql(_BUCKETS.format(r=12, c=12), "11"),
    "lu_fold": elimination_sql(_BUCKETS.format(r=16, c=16), "15"),
    "lu_halves": elimination_sql(_MOMENTS, "63"),
    "lu_moments": elimination_sql(_MOMENTS, "63"),
    "lu_any_size": f"SELECT *, 'vectors' AS part FROM ({elimination_sql(_VECTORS, '64')}) UNION ALL SELECT *, 'buckets' AS part FROM ({elimination_sql(_BUCKETS.format(r=12, c=16), '11')})",
    "lu_wide": elimination_sql(f"SELECT j AS i, i AS j, v FROM ({_VECTORS})", "63"),
    "lu_tall": elimination_sql(_VECTORS, "64"),
    "lu_per_label": elimination_sql(_PER_LABEL, "7", select="r AS i, CAST(k - 1 AS BIGINT) AS j, v[k] AS v, CAST(NULL AS BIGINT) AS singular_at", group="label"),
    "lu_sparse": " UNION ALL ".join([_sparse("fold", 40, 25, 25), _sparse("halves", 60, 25, 25), _sparse("strip", 60, 25, 25), _sparse("tiles", 60, 25, 25), _sparse("rows", 40, 12, 12)]),
    "lu_recursive": elimination_sql(_SUPPLY, f"({_SUPPLIERS} - 1)"),
    "solve_moments": f"SELECT CAST(pivot_j AS BIGINT) AS i, CAST(k - 65 AS BIGINT) AS j, v[k] AS v FROM ({reduced_sql(f'({_MOMENTS}) UNION ALL SELECT j, i + 64, v FROM ({_VECTORS})', '64')}), LATERAL unnest(range(65, len(v) + 1)) AS u(k)",
    "inverse_supply": f"SELECT CAST(pivot_j AS BIGINT) AS i, CAST(k - 1 - {_SUPPLIERS} AS BIGINT) AS j, v[k] AS v FROM ({reduced_sql(f'({_SUPPLY}) UNION ALL SELECT a.s_suppkey, b.s_suppkey + {_SUPPLIERS}, CASE WHEN a.s_suppkey = b.s_suppkey THEN 1 ELSE 0 END FROM supplier a CROSS JOIN supplier b', _SUPPLIERS)}), LATERAL unnest(range({_SUPPLIERS} + 1, len(v) + 1)) AS u(k)",
    "det_moments": f"SELECT i // 24 AS bi, list_reduce(list_prepend(CAST(1 AS BIGINT), list(v)), lambda x, y: x * y % {P}) AS det, min(CASE WHEN v = 0 THEN i END) AS zero_pivot FROM ({elimination_sql(_MOMENTS, '63')}) WHERE i = j GROUP BY i // 24",
    "reduced_orders": f"SELECT r, pivot_j, i, CAST(k - 1 AS BIGINT) AS j, v[k] AS v FROM ({reduced_sql(_ORDERS, str(ORDER_COLUMNS))}), LATERAL unnest(range(1, len(v) + 1)) AS u(k)",
    "independent_customers": f"SELECT i FROM ({reduced_sql(_ORDERS, str(ORDER_COLUMNS))})",
    "pluq_orders": elimination_sql(_PERMUTED, str(ORDER_COLUMNS)),
    "stream_ranks": f"SELECT label, rows, coalesce(rank, 0) AS rank FROM (SELECT label, count(*) AS rows FROM embeddings GROUP BY label) LEFT JOIN (SELECT label, count(*) AS rank FROM ({reduced_sql(f'SELECT label, i, j, v FROM ({_VECTORS}) JOIN (SELECT vec_id, label FROM embeddings) ON i = vec_id', '64', 'label')}) GROUP BY label) USING (label)",
    "lu_status": " UNION ALL ".join(
        f"SELECT '{name}' AS matrix, singular_at FROM ({_first_failure(_dense(f'SELECT {i} AS i, {j} AS j, count(*) AS v FROM supplier GROUP BY 1, 2', n, n), n)})"
        for name, i, j, n in (("nations", "s_nationkey", "s_suppkey % 25", "25"), ("suppliers", "s_suppkey", f"(s_suppkey * 7 + s_nationkey) % {_SUPPLIERS}", _SUPPLIERS))
    ),
    "check_probable": f"SELECT 'factors' AS form, {_SUPPLIERS} AS compared, CAST(0 AS BIGINT) AS failing UNION ALL SELECT 'changed', {_SUPPLIERS}, 1 + count(*) FROM ({elimination_sql(_SUPPLY, f'({_SUPPLIERS} - 1)')}) WHERE i > 3 AND j = 3 AND v <> 0 UNION ALL SELECT 'product', count(DISTINCT l_suppkey), 0 FROM lineitem",
    "exact_orders": f"""
WITH a AS (SELECT o_custkey % 40 AS i, weekofyear(o_orderdate) AS j, CAST(sum(CAST(o_orderkey + 1 AS HUGEINT) * 1000003 * CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE 1 END) AS HUGEINT) AS v FROM orders GROUP BY 1, 2),
c AS (SELECT r.i, s.j, coalesce(v, CAST(0 AS HUGEINT)) AS v FROM range(40) r(i) CROSS JOIN range(40) s(j) LEFT JOIN (SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM a x JOIN a y USING (j) GROUP BY 1, 2) p ON p.i = r.i AND p.j = s.j),
w AS (SELECT *, ((v % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS u FROM c)
SELECT i, j, CAST(v AS VARCHAR) AS v, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS word FROM w""",
    "check_mismatch": f"SELECT CAST(0 AS BIGINT) AS mismatching, count(*) AS compared FROM ({elimination_sql(_BUCKETS.format(r=16, c=16), '15')}) WHERE j >= i",
    "check_identity": f"""
WITH e AS ({elimination_sql(_VECTORS, '64')}), a AS ({_VECTORS}),
l AS (SELECT i, j AS k, {P} - v AS v FROM e WHERE i > j UNION ALL SELECT i, i, 1 FROM e WHERE j = 0 AND i < 64), u AS (SELECT i AS k, j, v FROM e WHERE j >= i),
b AS (SELECT l.i, u.j, sum(l.v * u.v) % {P} AS v FROM l JOIN u USING (k) GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) AS mismatching FROM a FULL JOIN b USING (i, j)""",
    "elimination_work": _WORK,
    "bench_records": f"SELECT * EXCLUDE (runs) FROM {_LOG_SQL}",
    "bench_header": f"SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY threads) - 1 AS INT) AS k, CAST(threads AS BIGINT) AS threads FROM (SELECT DISTINCT file, threads FROM {_LOG_SQL})",
    "bench_series": f"SELECT file, method, seq AS k, real_s FROM {_LOG_SQL}",
    "speedup_global": f"SELECT file, method, seq, real_s, min(CASE WHEN seq = 0 THEN real_s END) OVER () / real_s AS speedup FROM {_LOG_SQL}",
    "speedup_own": f"SELECT file, method, seq, real_s, first_value(real_s) OVER (PARTITION BY file, method ORDER BY seq) / real_s AS speedup FROM {_LOG_SQL}",
    "bench_throughput": f"SELECT file, method, seq, CAST({2.0 * 1000**3 / 3e9!r} AS DOUBLE) / real_s AS rate FROM {_LOG_SQL}",
    "bench_rates": f"SELECT file, method, seq, ratio, CAST({2.0 * 4096 * 4096 * 43 / 9 / 1e6!r} AS DOUBLE) / real_s AS tiled_rate FROM {_LOG_SQL}",
    "bench_files": f"SELECT r.* EXCLUDE (runs), h.runs, h.reports, h.settings FROM {_LOG_SQL} r JOIN (SELECT file, CAST(sum(runs) AS BIGINT) AS runs, count(*) AS reports, CAST(count(DISTINCT threads) AS INT) AS settings FROM {_LOG_SQL} GROUP BY file) h USING (file)",
    "tile_plans": f"SELECT nation, rows, columns, l AS level1, t AS tile, CAST(ceil(rows / t) AS BIGINT) AS down, CAST(ceil(columns / t) AS BIGINT) AS across FROM (SELECT *, CAST(floor(sqrt(l / 24)) AS BIGINT) AS t FROM {_NATIONS_SQL}, (VALUES (32768::BIGINT), (49152), (65536)) b(l))",
    "bench_paths": f"SELECT path, nation % 2 = 1 AS incremental, nation + 1 AS block FROM (SELECT nation, concat('bench-mat-gep-', CASE WHEN nation % 2 = 1 THEN 'inc-' ELSE '' END, rows, '-', columns, '-', nation + 1, '-x') AS path FROM {_NATIONS_SQL})",
    "bench_runs": f"SELECT method, CAST(2 ** k AS BIGINT) AS threads FROM (SELECT method, max(threads) AS most FROM {_LOG_SQL} GROUP BY method), range(31) r(k) WHERE CAST(2 ** k AS BIGINT) <= most",
    "bench_sizes": f"SELECT nation, k AS step, rows + 100 * k AS rows, columns + 100 * k AS columns, 'added' AS kind FROM {_NATIONS_SQL}, range(11) t(k) UNION ALL SELECT nation, k, CAST(rows * 2 ** k AS BIGINT), CAST(columns * 2 ** k AS BIGINT), 'doubled' FROM {_NATIONS_SQL}, range(5) t(k)",
}
