"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The product's entries are overlap counts of pairs of documents. Size-derived bounds discard
nearly all of it before it is formed:

1. Rows. A document with n n-grams can only link if at least threshold * n of them occur in
   another document. Occurrences are counted over the whole corpus, by blocks of documents (packed, see blocks.py);
   what stays are the documents that pass, with their shared n-grams.
2. Columns. In one order of the n-grams for all documents, rarest first, two linked documents share one of the first
   n - ceil(threshold * n) + 1 of each (of the smaller document even one of the first n - ceil(2 t / (1 + t) * n) + 1),
   so only these columns are multiplied, and only for rows whose sizes and shared n-grams allow a link.
3. Entries. The columns are dealt into BLOCKS blocks by their hash. Pairs that met in a column are the entries asked for; block after
   block of columns is multiplied for them and adds to their overlap counts. An entry goes as soon as its count and what the later
   blocks can add at most (the smaller of both rows' n-grams there) stay below the least overlap that its sizes need.

Within a column, rows are compared with one of them first, the one with the fewest n-grams of its own; components of what
links are formed, and only rows still in different components are compared further. So a group of copies
costs a number of entries in proportion to its rows, and no link between components is lost.

The result has one row for each document: its number of n-grams and its component. Equal sets (by two 64-bit digests and
their size) are merged first. N-grams of a pair are compared by 64-bit hashes, of which two texts have too few for false equalities to
matter. Null, empty and blank texts have no n-grams and link with nothing. A very long text is one document of its block.
Rows with the same id are separate rows that share the id, which links nothing; null ids count as larger than all; ids are of any type
with an order. Components of different texts may so have one component_id; _component tells them apart. Ties of similarity at the
threshold link. Other columns are not looked at and may have any names. Empty tables give no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm import blocks
from riskspark.llm.components import checkpoint, components, shuffled
from riskspark.llm.textwords import chunks, mix, window_starts, windows, words

WORDS, PERCENT = 5, 80
#: Rows of one column in one task, about, where its rows are compared with each other.
CELL = 512
#: Blocks of columns whose partial products are added up one after the other.
BLOCKS = 4


def _sets(table: pa.Table, n: int):
    """For each text the sorted distinct hashes of its n-grams, or of the whole sequence if it is shorter."""
    for i, j, data, offsets in chunks(table["_text"]):
        hashes, at = words(data, offsets, lower=True)
        starts = window_starts(at, n)
        grams = windows(hashes, n)[starts] if len(starts) else np.zeros(0, np.uint64)
        edges = np.searchsorted(starts, at)
        for k in range(j - i):
            own = grams[edges[k] : edges[k + 1]]
            if len(own):
                yield np.unique(own)
            else:
                short = hashes[at[k] : at[k + 1]]
                yield windows(short, len(short)) if len(short) else short


def link_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id, _text_key, _component: documents link where 100 * intersection >= percent * union.

    _text_key: hash of the text. _component: a name of the component of texts, null where a text links with none and has no copy."""
    total = blocks.corpus_size(docs, text)
    kind, n_blocks = blocks.id_type(docs, id_col), blocks.count_of(total)
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    dealt = blocks.deal(keyed.withColumn("_text_key", text_key("_text")), total, "_id", "_text", more=("_text_key",))
    bits, parts = blocks.key_bits(total // 4), n_blocks

    def count(table: pa.Table) -> pa.Table:
        keys = [k >> np.uint64(64 - bits) for k in _sets(table, n)]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return blocks.send(table["_block"][0].as_py(), keys, np.ones(len(keys), bool), parts, bits)

    shared = blocks.repeated(dealt.groupBy("_block").applyInArrow(count, blocks.REPEAT_SCHEMA), parts, n_blocks)
    fields = [("_text_key", pa.int64()), ("_n", pa.int64()), ("_s1", pa.int64()), ("_s2", pa.int64()), ("_early", pa.list_(pa.int32())), ("_ends", pa.list_(pa.int32())), ("_keys", pa.list_(pa.int64()))]
    lists = ("_early", "_ends", "_keys")

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        out, known = {f: [] for f, _ in fields}, set()
        hit, often = blocks.answers(right)
        for own, keys in zip(left["_text_key"].to_pylist(), _sets(left, n), strict=True):
            out["_text_key"].append(own)
            out["_n"].append(len(keys))
            short = keys >> np.uint64(64 - bits)
            good = blocks.found(short, hit) if len(keys) else np.zeros(0, bool)
            most = int(good.sum()) - -(-percent * len(keys) // 100)  # shared ones beyond the least that a link needs
            if len(keys) and most >= 0:
                with np.errstate(over="ignore"):
                    same = (int(keys.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(keys)).view(np.int64)))
                out["_s1"].append(same[0])
                out["_s2"].append(same[1])
                values = (None, None, None)
                if same not in known:
                    shared, times = keys[good], often[np.searchsorted(hit, short[good])]
                    block = shared % np.uint64(BLOCKS)
                    order = np.argsort(block, kind="stable")
                    shared, times = shared[order], times[order]
                    early = np.lexsort((shared, times))[: most + 1]  # places of the rarest ones, rarest first
                    values = early.astype(np.int32), np.cumsum(np.bincount(block.astype(np.int64), minlength=BLOCKS)).astype(np.int32), shared.view(np.int64)
                for f, value in zip(lists, values, strict=True):
                    out[f].append(value)
                known.add(same)
            else:
                for f in ("_s1", "_s2", *lists):
                    out[f].append(None)
        return pa.table(out, pa.schema(fields)).add_column(0, "_id", left["_id"])

    rows = checkpoint(dealt.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(bound, f"_id {kind}, _text_key long, _n long, _s1 long, _s2 long, _early array<int>, _ends array<int>, _keys array<long>"))
    same = ["_s1", "_s2", "_n"]
    node = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"))  # null ids come last
    classes = checkpoint(rows.where("_s1 is not null").groupBy(*same).agg(F.min(node).alias("node"), *[F.first(f, ignorenulls=True).alias(f[1:]) for f in lists]))
    seed = _seed(classes, same)
    nodes = classes.select(F.xxhash64(F.lit(seed), *same).alias("row"), "node", F.col("_n").alias("n"), F.size("keys").alias("shared"), "early", "ends", "keys")
    few = F.col("shared") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1  # as the smaller of a pair
    columns = nodes.select(F.posexplode(F.transform("early", lambda i: F.col("keys")[i])).alias("_at", "key"), "row", "n", "shared", few.alias("_few"))
    columns = columns.select("key", "row", "n", "shared", F.col("_at").alias("at"), (F.col("_at") < F.col("_few")).alias("early"))
    met = columns.groupBy("key").agg(F.count("*").alias("_rows"), F.max("early").alias("_early")).where("_rows > 1 and _early")
    # a column of many rows is dealt over cells by its rows, so none lands in one task
    met = met.select("key", F.ceil(F.col("_rows") / CELL).cast("int").alias("cells"))
    met = checkpoint(columns.join(shuffled(met), "key").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")).cast("int")))
    labels = nodes.select("row", F.col("row").alias("label"))
    links = tested = None

    def fits(a, b):
        """Bounds of two rows that meet in a column: from their sizes, and from what stands before and after the column in each."""
        n, m = a("n"), b("n")
        most = F.least(a("at"), b("at")) + F.least(a("shared") - a("at"), b("shared") - b("at"))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)

    best = F.max(F.struct((F.col("shared") / F.col("n")).alias("rank"), "row", "label", "n", "shared", "at")).alias("hub")
    of = lambda prefix: lambda c: F.col(f"{prefix}{c}")
    for last in (False, False, True):
        if links is not None and not links.isEmpty():
            found = components(links)
            labels = checkpoint(nodes.select("row").join(shuffled(found), F.col("row") == found["node"], "left").select("row", F.coalesce("component", "row").alias("label")))
        placed = met.join(shuffled(labels), "row")
        each = placed.groupBy("key", "cell").agg(best, F.min("label").alias("_low"), F.max("label").alias("_top"), F.first("cells").alias("cells"))
        open_keys = each.groupBy("key").agg(F.max("hub").alias("hub"), F.min("_low").alias("_low"), F.max("_top").alias("_top"), F.first("cells").alias("cells")).where("_low < _top")
        open_keys = open_keys.select("key", "hub", _cells("cells").alias("cell"))
        at = placed.join(shuffled(open_keys), ["key", "cell"])
        if last:
            mine, theirs = at.withColumn("_cell", _cells("cells")), at.withColumn("_cell", F.col("cell")).drop("cell").withColumn("cell", _cells("cells"))
            other = theirs.select("key", "cell", "_cell", F.col("row").alias("y"), *[F.col(c).alias(f"_{c}") for c in ("n", "shared", "at", "label", "early")])
            early = F.when(F.col("n") == F.col("_n"), F.col("early") | F.col("_early")).when(F.col("n") < F.col("_n"), F.col("early")).otherwise(F.col("_early"))
            pairs = mine.join(shuffled(other), ["key", "cell", "_cell"]).where((F.col("label") < F.col("_label")) & early & fits(of(""), of("_"))).select(F.col("row").alias("x"), "y")
        else:
            at = at.where(F.col("label") != F.col("hub.label"))
            if tested is not None:  # the best row has been compared; now the best one outside its component
                at = at.drop("hub")
                hubs = at.groupBy("key", "cell").agg(best, F.first("cells").alias("cells")).groupBy("key").agg(F.max("hub").alias("hub"), F.first("cells").alias("cells"))
                at = at.join(shuffled(hubs.select("key", "hub", _cells("cells").alias("cell"))), ["key", "cell"]).where(F.col("label") != F.col("hub.label"))
            at = at.where(fits(of(""), of("hub.")))
            pairs = at.select(F.col("hub.row").alias("x"), F.col("row").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(shuffled(tested), ["x", "y"], "left_anti")
        pairs = checkpoint(pairs)
        linked = checkpoint(multiplied(pairs, nodes, percent))
        links = linked if links is None else checkpoint(links.union(linked))
        tested = pairs if tested is None else tested.union(pairs)
    if not links.isEmpty():
        found = components(links)
        labels = nodes.select("row", "node").join(shuffled(found.withColumnRenamed("node", "_at")), F.col("row") == F.col("_at"), "left").select("row", "node", F.coalesce("component", "row").alias("label"))
    else:
        labels = nodes.select("row", "node", F.col("row").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("node").alias("component_id"))
    named = labels.join(shuffled(smallest), "label").select("row", "component_id", "label")
    out = rows.select("_id", "_text_key", "_n", F.when(F.col("_s1").isNotNull(), F.xxhash64(F.lit(seed), *same)).alias("_row"))
    out = out.join(shuffled(named), F.col("_row") == F.col("row"), "left")
    component = F.when(F.col("label").isNotNull(), F.col("component_id.id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), "_text_key", F.col("label").alias("_component"))


def multiplied(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The entries (x, y) of the product, among the pairs asked for, whose overlap reaches the bound of their sizes.

    nodes: row, n (size of the set), keys (the n-grams that occur in other rows, block by block of columns) and ends (of the blocks in keys).
    A block of columns adds its overlap to a pair's count; what the later blocks can add is bounded by the rows' n-grams there, so
    a pair below its bound is discarded after the block that shows it. After the last block nothing can be added and the bound is exact."""
    entries = pairs.select("x", "y", F.lit(0).alias("_count"))
    for b in range(BLOCKS):
        start = F.col("ends")[b - 1] if b else F.lit(0)
        block, later = F.slice("keys", start + 1, F.col("ends")[b] - start), F.size("keys") - F.col("ends")[b]
        x, y = (nodes.select(F.col("row").alias(c), F.col("n").alias(f"_n{c}"), block.alias(f"_k{c}"), later.alias(f"_later{c}")) for c in "xy")
        met = entries.join(shuffled(x), "x").join(shuffled(y), "y").withColumn("_count", F.col("_count") + F.size(F.array_intersect("_kx", "_ky")))
        most = F.col("_count") + F.least("_laterx", "_latery")
        entries = met.where(most * (100 + percent) >= (F.col("_nx") + F.col("_ny")) * percent).select("x", "y", "_count")
    return entries.select("x", "y")


def text_key(text: str) -> Column:
    """Hash of a text, null as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _cells(of: str) -> Column:
    """A row for each cell of a column."""
    return F.explode(F.sequence(F.lit(0), F.col(of) - 1))


def _seed(classes: DataFrame, digests: list[str]) -> int:
    """A seed with which no two digests have one 64-bit hash, so that a row's number is its own."""
    seed = 0
    while not classes.groupBy(F.xxhash64(F.lit(seed), *digests).alias("h")).count().where("count > 1").isEmpty():
        seed += 1
    return seed


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of texts the document with the smallest id, with all columns; of several texts of this id, and of its
    rows with that text, one. Documents that link with nothing all stay, whatever their ids. Columns may have any names."""
    classes = checkpoint(classes)  # read three times below
    each = classes.where("_component is not null").groupBy("_component", F.col(id_col).alias("id"), "_text_key").agg(F.count("*").alias("n"))
    least = each.groupBy("_component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("kept"), F.col("_text_key").alias("kept_key"), "n")).alias("one"))
    alone = classes.where("_component is null").select(F.col(id_col).alias("kept"), F.col("_text_key").alias("kept_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_key(text).alias("key"))
    named = lambda kept: rows.join(shuffled(kept), F.col("id").eqNullSafe(F.col("kept")) & (F.col("key") == F.col("kept_key")), "left_semi")
    many = least.select("one.*").where("n > 1")
    out = named(least.select("one.*").where("n = 1").select("kept", "kept_key").union(alone))
    if not many.isEmpty():
        out = out.union(named(many).dropDuplicates(["id", "key"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at 90 percent of 3-word shingles."""
    return link_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")
