"""Near-dedup of embeddings by spherical k-means cells and blocked cosine products.

Equal vectors are one representative from the start. Centres of cells are fitted per label by
spherical k-means on a bounded sample; every vector belongs to the cell of its nearest centre, and
also visits each other cell in which a vector within the threshold's angle may lie. A vector u of
cell c has u.c >= u.d for every other centre d; so if v, of cell d, is within the angle a of u,
v.(d - c) <= sin(a) |d - c|. Cells in which this holds for no such u are not visited, and no link is
lost; of two cells only the lower-numbered one is visited from the other. Labels of very many vectors get
their centres in two steps: the cells of the first ones are divided again around centres of their own. Within a cell, blocks of home vectors are compared with each other and with blocks of visitors, in
double precision; visitors are never compared with visitors.

Cells must pay: rows that blocks deal out are estimated on vectors of the sample that centres were not fitted on, for
several sizes of cells, and a label has cells only if they save half of what its plain blocks deal out. What
they do deal out is counted then, and a label that would be better off without them goes without.

Scale: cells are cut into blocks of bounded size and a task holds two. Tasks emit, per vector, how
many links it has in the block pair and the least vector of its local component, never pairs.
Centres are bounded by ``MOST_CELLS`` per level and by ``SAMPLE`` rows in all, and broadcast; beyond
that bound (4,096 cells a label, 16 million vectors), cells have more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, spread_join, whole_runs
from tidemark.llm.components import components, local_roots

THRESHOLD = 0.93
#: Vectors a cell should have, and the most cells that a label, or a cell of a label, is divided into.
CELL, MOST_CELLS = 4096, 64
#: Vectors of the sample that a centre needs at least.
SEEN = 4
#: Vectors that centres are fitted on, in all labels together (in expectation).
SAMPLE = 20_000
ROUNDS = 8
BLOCK = 2048

#: By label and dimension: the centres, and the centres within the cell of each.
Centres = dict[tuple[str, int], tuple[np.ndarray, list[np.ndarray]]]


def kmeans(unit: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """k unit centres of unit vectors: each round, the normalised mean of the nearest vectors.
    Centres without vectors stay where they were."""
    centres = unit[np.random.default_rng(seed).choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dealt_rows(home: np.ndarray, visitors: np.ndarray, block: int) -> int:
    """Rows that cells with so many home vectors and visitors deal to pairs of blocks."""
    own, others = -(-home // block), -(-visitors // block)
    return int((home * (own + others) + visitors * own).sum())


def fit_centres(marks: DataFrame, cell: int = CELL, most_cells: int = MOST_CELLS, sample: int = SAMPLE, threshold: float = THRESHOLD, block: int = BLOCK) -> Centres:
    """Centres per label and dimension, as many as pay; none for labels in which none do. Labels with less
    than two cells are not sampled."""
    sizes = marks.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return {}
    share = min(1.0, sample / total)
    chosen = marks.join(F.broadcast(sizes.orderBy(F.desc("n")).limit(sample)), ["label", "dim"])
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share))
    found: dict[tuple[str, int], tuple[int, list]] = {}
    for r in chosen.select("label", "dim", "n", "embedding").collect():
        found.setdefault((r.label, r.dim), (r.n, []))[1].append(r.embedding)
    fitted = {key: _paying(_unit(v), n, cell, most_cells, threshold, block) for key, (n, v) in found.items()}
    return {key: centres for key, centres in fitted.items() if centres is not None}


def _paying(unit: np.ndarray, n: int, cell: int, most_cells: int, threshold: float, block: int) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """Centres for n vectors, fitted on one half of a sample and judged by the other; None if no size of
    cells halves the rows that plain blocks deal out."""
    fitted, best, least = unit[::2], None, dealt_rows(np.array([n]), np.array([0]), block) / 2
    if len(unit) < 4 * SEEN:
        return None
    for size in (cell // 64, cell // 16, cell // 4, cell):
        centres = _two_levels(fitted, n, max(1, size), most_cells)
        _, cells, home = downward(unit[1::2], centres, threshold)
        counts = [np.bincount(cells[x], minlength=most_cells * MOST_CELLS) * (n / len(unit[1::2])) for x in (home, ~home)]
        if (rows := dealt_rows(*(np.ceil(c).astype(np.int64) for c in counts), block)) < least:
            best, least = centres, rows
    return best


def _two_levels(unit: np.ndarray, n: int, cell: int, most_cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres for n vectors from a sample of them; cells that are still large are divided again."""
    coarse = kmeans(unit, min(most_cells, -(-n // cell), len(unit)))
    near = (unit @ coarse.T).argmax(1)
    fine = []
    for i in range(len(coarse)):
        own = unit[near == i]
        k = min(most_cells, round(n * len(own) / len(unit) / cell), len(own) // SEEN)
        fine.append(kmeans(own, k) if k > 1 else coarse[i : i + 1])
    return coarse, fine


def visited(unit: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre of each vector, which cells each vector is in, that one included)."""
    near = unit @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 0))
    sine = (1 - threshold * threshold) ** 0.5 if threshold > 0 else 1.0
    inside = near[np.arange(len(unit)), home][:, None] - near <= sine * apart + 1e-9
    inside[np.arange(len(unit)), home] = True
    return home, inside


def visits(unit: np.ndarray, centres: tuple[np.ndarray, list[np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether the row is at home there) for all cells that vectors are in. A vector is at home in
    the cell of the nearest of all centres of the second level, which are numbered by their first one."""
    flat = np.concatenate(centres[1])
    number = np.concatenate([i * MOST_CELLS + np.arange(len(f)) for i, f in enumerate(centres[1])])
    rows, cells, at_home = [], [], []
    for a in range(0, len(unit), 512):
        home, inside = visited(unit[a : a + 512], flat, threshold)
        r, c = np.nonzero(inside)
        rows.append(a + r)
        cells.append(number[c])
        at_home.append(home[r] == c)
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(at_home)


def downward(unit: np.ndarray, centres: tuple[np.ndarray, list[np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``visits``, those at home and those to cells of lower numbers: two cells need meet only once."""
    row, cell, own = visits(unit, centres, threshold)
    number = np.empty(len(unit), np.int64)
    number[row[own]] = cell[own]
    kept = own | (cell < number[row])
    return row[kept], cell[kept], own[kept]


def _placed(marks: DataFrame, centres: Centres, threshold: float) -> DataFrame:
    """Every vector once for each cell that it is in."""
    shared = marks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            rows, cells, homes = [], [], []
            groups: dict[tuple[str, int], list[int]] = {}
            for i in range(n):
                groups.setdefault((labels[i], dims[i]), []).append(i)
            for key, of in groups.items():
                at = np.array(of)
                if key not in shared.value:
                    rows.append(at), cells.append(np.zeros(len(at), np.int64)), homes.append(np.ones(len(at), bool))
                    continue
                r, c, home = downward(_unit(batch.column("embedding").take(pa.array(at)).to_pylist()), shared.value[key], threshold)
                rows.append(at[r]), cells.append(c), homes.append(home)
            if n:
                take = pa.array(np.concatenate(rows))
                arrays = [batch.column(c).take(take) for c in ("vec_id", "weight", "label", "dim", "embedding")]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(np.concatenate(cells), pa.int64()), pa.array(np.concatenate(homes))], names=["vec_id", "weight", "label", "dim", "embedding", "cell", "home"]
                )

    return marks.select("vec_id", "weight", "label", "dim", "embedding").mapInArrow(
        run, "vec_id long, weight long, label string, dim int, embedding array<double>, cell long, home boolean"
    )


def _block_links(weights: np.ndarray, home: np.ndarray, block: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector counted in this pair of blocks, root of its local component). Blocks of home
    vectors count the links between them, or within the one; a block of visitors counts those with the
    home vectors."""
    n = len(home)
    counts, roots = np.zeros(n, np.int64), np.arange(n)
    side = block if home.all() else home
    apart = side.min() != side.max()
    for a in range(0, n, 512):
        near = unit[a : a + 512] @ unit.T >= threshold
        i, j = np.nonzero(near)
        i += a
        ok = side[i] != side[j] if apart else i != j
        i, j = i[ok], j[ok]
        np.add.at(counts, i, weights[j])
        roots = local_roots(n, i, j, roots)
    return counts, roots


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("others"))


def placed_in_cells(marks: DataFrame, centres: Centres, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Every vector once for each cell that it is in, and the numbers of home vectors and visitors of cells. Labels
    whose cells deal out more rows than plain blocks would go without cells."""
    while True:
        placed = durable(_placed(marks, centres, threshold))
        sizes = durable(_sizes(placed))
        blocks = lambda c: F.ceil(F.col(c) / block)
        rows = F.sum(F.col("own") * (blocks("own") + blocks("others")) + F.col("others") * blocks("own"))
        totals = sizes.groupBy("label", "dim").agg(rows.alias("rows"), F.sum("own").alias("n")).where(F.col("rows") > F.col("n") * blocks("n"))
        worse = {(r.label, r.dim) for r in totals.collect()} & centres.keys() if centres else set()
        if not worse:
            return placed, sizes
        centres = {k: c for k, c in centres.items() if k not in worse}


def near_links(marks: DataFrame, centres: Centres, threshold: float, block: int = BLOCK) -> DataFrame:
    """(vec_id, n, root) per vector and pair of blocks in which it has links."""
    placed, sizes = placed_in_cells(marks, centres, threshold, block)
    cell = ["label", "dim", "cell"]
    blocks = sizes.select(*cell, *[F.ceil(F.col(c) / block).alias(f"n_{c}") for c in ("own", "others")]).where("n_own > 0")
    numbered = placed.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.when(F.col("home"), F.col("n_own")).otherwise(F.col("n_others"))))
    # pairs of home blocks (kind 0), and of a home block with a block of visitors (kind 1)
    with_own = "transform(sequence(0L, n_own - 1), j -> struct(0 AS kind, least(block, j) AS first, greatest(block, j) AS second))"
    with_others = "IF(n_others > 0, transform(sequence(0L, n_others - 1), j -> struct(1 AS kind, block AS first, j AS second)), array())"
    as_visitor = "transform(sequence(0L, n_own - 1), j -> struct(1 AS kind, j AS first, block AS second))"
    dealt = numbered.withColumn("_to", F.explode(F.expr(f"IF(home, concat({with_own}, {with_others}), {as_visitor})")))
    dealt = dealt.select("vec_id", "weight", *cell, "embedding", "home", "block", "_to.kind", "_to.first", "_to.second")
    keys = [*cell, "kind", "first", "second"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, keys):
            n = table.num_rows
            change = np.zeros(n, bool)
            for k in keys:
                c = table.column(k).to_numpy()
                change[1:] |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.nonzero(change)[0], [n]])
            ids, weights, home, blocks = (table.column(c).to_numpy() for c in ("vec_id", "weight", "home", "block"))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = table.column("embedding").slice(a, b - a).combine_chunks()
                unit = part.flatten().to_numpy().reshape(b - a, -1)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                counts, roots = _block_links(weights[a:b], home[a:b].astype(bool), blocks[a:b], unit, threshold)
                some = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][some]), pa.array(counts[some]), pa.array(ids[a:b][roots[some]])], names=["vec_id", "n", "root"])

    return dealt.mapInArrow(run, "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if labels are equal, dimensions too, and the cosine reaches ``threshold``. Rows with
    a null label, or a vector that is null, empty, zero or has null or non-finite components, link
    with nothing. Equal vectors of a label link with each other. Rows without an id are left out;
    rows that repeat an id are vectors of their own, and all that have the kept id are marked kept. An
    empty table gives no rows; other columns are ignored.
    """
    bad = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) OR NOT exists(embedding, x -> x <> 0)"
    rows = durable(
        vectors.where(F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        .withColumn("valid", F.coalesce(F.col("label").isNotNull() & F.expr(f"NOT ({bad})"), F.lit(False)))
        # adding zero turns a negative zero into the zero that it equals
        .select("vec_id", "valid", "label", F.expr("transform(embedding, x -> x + 0D)").alias("embedding"))
        .withColumn("same", F.when(F.col("valid"), F.sha2(F.concat_ws(",", "label", F.to_json(F.struct("embedding"))), 256)))
    )
    # one mark per vector, numbered apart from ids, as these may repeat
    marks = durable(
        rows.where("valid").groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")).withColumn("mark", F.monotonically_increasing_id())
    )
    found = durable(near_links(marks.drop("vec_id").withColumnRenamed("mark", "vec_id"), fit_centres(marks, cell, threshold=threshold, block=block), threshold, block))
    counts = found.groupBy(F.col("vec_id").alias("mark")).agg(F.sum("n").alias("n"))
    classes = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("mark"), "component")
    named = marks.select("same", "mark", "vec_id", "weight").join(counts, "mark", "left").join(classes, "mark", "left")
    named = durable(named.select("same", "mark", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "mark").alias("component")))
    least = named.groupBy("component").agg(F.min("vec_id").alias("class"))
    named = spread_join(named, least, "component", "mark").select("same", "n_links", "class")
    out = spread_join(rows.select("vec_id", "same"), named, "same", "vec_id")
    component = F.coalesce("class", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), r AS (
  SELECT a AS n, b AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a
), c AS (SELECT n, min(m) AS m FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(c.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
