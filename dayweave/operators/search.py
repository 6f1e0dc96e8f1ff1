"""Full-text search over descriptions and entity values with posting tables.

An index on disk is a list of runs that are never changed. A change writes a run of its own, with an empty
length for documents that are gone, and newer runs hide the documents of older ones. Runs of similar size are
then merged, so there are few of them and a document is rewritten a logarithmic number of times.

A run keeps postings in the order of term and block. A block holds the documents of one class of length, as
short documents score highest; its size and highest term count bound what its documents can score. A search
scores the most promising blocks first and then only those that can still reach the best documents found.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayweave.functions import words
from dayweave.session import ensure_checkpoint_dir

# Default ranking constants of BM25.
K1, B = 1.2, 0.75
#: Classes of length per doubling; blocks that are scored first; times a run may outweigh all newer ones.
CLASSES, FIRST_BLOCKS, OUTWEIGH = 4, 4, 2


class Index(NamedTuple):
    """Postings ``(term, doc_id, tf, length)`` and document lengths ``(doc_id, length)``."""

    postings: DataFrame
    documents: DataFrame


def build_index(docs: DataFrame, *, stems: bool = True) -> Index:
    """Index of ``(doc_id, text)`` rows.

    Term counts are combined before the shuffle and keyed by document and term, so neither a frequent
    term nor a long document meets in one task. A posting carries the length of its document.
    """
    listed = docs.select("doc_id", words.tokens(F.coalesce("text", F.lit(""))).alias("terms")).withColumn("length", F.size("terms").cast("long"))
    # Stems are worked out where the words are, so terms are counted, and shuffled, once.
    found = listed.withColumn("terms", words.stems("terms")) if stems else listed
    counted = found.select("doc_id", "length", F.explode("terms").alias("term")).groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))
    return Index(counted.select("term", "doc_id", "tf", "length"), listed.select("doc_id", "length"))


def length_class(length: Column) -> Column:
    """Block of a document: ``CLASSES`` per doubling of its length."""
    return F.floor(CLASSES * F.log2(length + 1)).cast("int")


class Run(NamedTuple):
    """A written run: its number, documents (gone ones included) and the batch it came from."""

    run: int
    docs: int
    batch: int


class StoredIndex:
    """The runs of an index in a folder, oldest first, as the newest list of them names them."""

    def __init__(self, spark: SparkSession, path: str, version: int = 0, runs: Sequence[Run] = ()):
        self.spark, self.path, self.version, self.runs = spark, path, version, list(runs)

    @property
    def postings(self) -> DataFrame:
        return self.live("postings").select("term", "doc_id", "tf", "length")

    @property
    def documents(self) -> DataFrame:
        return self.live("documents").where("length is not null").select("doc_id", "length")

    def part(self, name: str, run: Run) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/run-{run.run}")

    def newer(self, place: int, runs: Sequence[Run]) -> DataFrame | None:
        """Documents of the runs after ``place``."""
        later = [self.part("documents", r).select("doc_id") for r in runs[place + 1 :]]
        out = None
        for one in later:
            out = one if out is None else out.unionByName(one)
        return None if out is None else out.distinct()

    def live(self, name: str, runs: Sequence[Run] | None = None, where: Column | None = None) -> DataFrame:
        """Rows of all runs that no newer run hides; the few newer documents are what is joined."""
        runs = self.runs if runs is None else list(runs)
        out = None
        for n, run in enumerate(runs):
            rows = self.part(name, run)
            rows = rows if where is None else rows.where(where)
            later = self.newer(n, runs)
            rows = rows if later is None else rows.join(later, "doc_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out


def write_index(index: Index, path: str) -> StoredIndex:
    """Write an index to a new folder as one run."""
    return _add_run(StoredIndex(index.postings.sparkSession, path), index, -1)


def load_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index of a folder written by :func:`write_index` and :func:`change_index`; empty for a new folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return StoredIndex(spark, path)
    lists = spark.read.parquet(f"{path}/runs")
    newest = lists.where(F.col("version") == lists.agg(F.max("version")).scalar()).orderBy("place").collect()
    return StoredIndex(spark, path, newest[0].version, [Run(r.run, r.docs, r.batch) for r in newest])


def stored(index: Index) -> StoredIndex:
    """The index written once to a new folder of the shared checkpoint folder, for several reads."""
    spark = index.postings.sparkSession
    return write_index(index, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")


def _write_run(stored_index: StoredIndex, postings: DataFrame, documents: DataFrame, run: int) -> int:
    """Write a run; returns its number of documents.

    Postings are dealt by ranges of term, block and document, so a frequent term lies in many files, and the
    row groups of other terms and blocks are skipped by their statistics.
    """
    path, order = stored_index.path, ["term", "block", "doc_id"]
    placed = postings.select("term", length_class(F.col("length")).alias("block"), "doc_id", "tf", "length")
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings/run-{run}")
    written = stored_index.spark.read.parquet(f"{path}/postings/run-{run}")
    blocks = written.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("shortest"))
    blocks.repartitionByRange("term").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks/run-{run}")
    documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/documents/run-{run}")
    return stored_index.spark.read.parquet(f"{path}/documents/run-{run}").count()


def _add_run(old: StoredIndex, index: Index, batch: int) -> StoredIndex:
    """The index with a further run, merged with as many of the newest ones as it is not much smaller than."""
    number = 1 + max([r.run for r in old.runs], default=-1)
    runs = [*old.runs, Run(number, _write_run(old, index.postings, index.documents, number), batch)]
    take, total = 1, runs[-1].docs
    while take < len(runs) and runs[-take - 1].docs <= OUTWEIGH * total:
        take += 1
        total += runs[-take].docs
    if take > 1:
        some, number = runs[-take:], number + 1
        documents = old.live("documents", some)
        if take == len(runs):
            # Nothing older is left to hide.
            documents = documents.where("length is not null")
        runs = [*runs[:-take], Run(number, _write_run(old, old.live("postings", some), documents, number), batch)]
    # The list is written last: until then readers see the runs of the list before.
    rows = [(old.version + 1, n, *r) for n, r in enumerate(runs)]
    old.spark.createDataFrame(rows, "version long, place int, run int, docs long, batch long").coalesce(1).write.mode("append").parquet(f"{old.path}/runs")
    _forget(old, {r.run for r in [*old.runs, *runs]})
    return StoredIndex(old.spark, old.path, old.version + 1, runs)


def _forget(index: StoredIndex, kept: set[int]) -> None:
    """Remove runs that neither the newest list nor the one before it names, so a reader of that one goes on."""
    hadoop = index.spark._jvm.org.apache.hadoop.fs
    for name in ("postings", "blocks", "documents"):
        folder = hadoop.Path(f"{index.path}/{name}")
        system = folder.getFileSystem(index.spark._jsc.hadoopConfiguration())
        for found in system.listStatus(folder):
            if int(found.getPath().getName().rsplit("-", 1)[-1]) not in kept:
                system.delete(found.getPath(), True)


def change_index(old: StoredIndex, changed: DataFrame, deleted: DataFrame | None = None, *, stems: bool = True, batch: int = -1) -> StoredIndex:
    """The index after inserting or replacing ``changed(doc_id, text)`` and removing ``deleted(doc_id)``.

    A null text is an empty document, not a removed one; a document in both is replaced. The cost follows the
    change, not the index. A ``batch`` that was added before changes nothing.
    """
    if batch >= 0 and any(r.batch >= batch for r in old.runs):
        return old
    fresh = build_index(changed, stems=stems)
    documents = fresh.documents
    if deleted is not None:
        gone = deleted.select("doc_id").distinct().join(changed.select("doc_id"), "doc_id", "left_anti")
        documents = documents.unionByName(gone.withColumn("length", F.lit(None).cast("long")))
    return _add_run(old, Index(fresh.postings, documents), batch)


def query_terms(spark, queries: Sequence[str], *, stems: bool = True) -> DataFrame:
    """Distinct terms of the given query texts as ``(query_no, term, terms)``."""
    rows = spark.createDataFrame(list(enumerate(queries)), "query_no int, text string")
    listed = rows.select("query_no", F.explode(words.tokens(F.col("text"))).alias("term"))
    if stems:
        listed = listed.withColumn("term", words.stem("term"))
    listed = listed.distinct()
    return listed.join(listed.groupBy("query_no").agg(F.count("*").alias("terms")), "query_no")


def _totals(index: StoredIndex) -> tuple[int, float]:
    """Number of documents and their mean length."""
    row = index.documents.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return row.n, row.mean or 0.0


def _hidden(index: StoredIndex, asked: Column) -> DataFrame | None:
    """Postings per term that newer runs hide."""
    out = None
    for n, run in enumerate(index.runs[:-1]):
        some = index.part("postings", run).where(asked).join(index.newer(n, index.runs), "doc_id", "left_semi").select("term")
        out = some if out is None else out.unionByName(some)
    return None if out is None else out.groupBy("term").agg(F.count("*").alias("hidden"))


def search(index: Index | StoredIndex, queries: Sequence[str], k: int = 20, *, stems: bool = True) -> DataFrame:
    """The ``k`` best documents per query that hold all its terms, by BM25, smallest id first on a tie.

    Terms and blocks become filters that reach the scan of the postings, which skips the row groups of others.
    Blocks are ranked by the most their documents can score; the first few give ``k`` documents whose last
    score the other blocks must be able to reach, or they are not read. Nothing is lost by that: a bound is
    never below a score. An index not written yet is written first.
    """
    if isinstance(index, Index):
        index = stored(index)
    spark = index.spark
    ensure_checkpoint_dir(spark)
    asked = query_terms(spark, queries, stems=stems)
    names = [r.term for r in asked.select("term").distinct().collect()]
    wanted = F.col("term").isin(names)
    n_docs, mean = _totals(index) if index.runs else (0, 0.0)
    if not n_docs:
        kind = index.part("documents", index.runs[0]).schema["doc_id"].dataType.simpleString() if index.runs else "long"
        return spark.createDataFrame([], f"query_no int, rank int, doc_id {kind}, score double")
    blocks = None
    for run in index.runs:
        some = index.part("blocks", run).where(wanted)
        blocks = some if blocks is None else blocks.unionByName(some)
    blocks = blocks.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
    counts, hidden = blocks.groupBy("term").agg(F.sum("n").alias("df")), _hidden(index, wanted)
    if hidden is not None:
        counts = counts.join(hidden, "term", "left").select("term", (F.col("df") - F.coalesce("hidden", F.lit(0))).alias("df"))
    idf = F.greatest(F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    asked = asked.join(counts.select("term", idf.alias("idf")), "term").checkpoint()

    def points(tf: Column, length: Column) -> Column:
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) if mean else F.col("idf") * 0

    bounds = blocks.join(asked, "term").groupBy("query_no", "block", "terms").agg(F.sum(points(F.col("most"), F.col("shortest"))).alias("bound"), F.count("*").alias("found"))
    bounds = bounds.where("found = terms").select("query_no", "block", "bound").checkpoint()
    promising = Window.partitionBy("query_no").orderBy(F.desc("bound"), "block")
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "doc_id")

    def scored(chosen: DataFrame) -> DataFrame:
        low, high = chosen.agg(F.coalesce(F.min("block"), F.lit(0)), F.coalesce(F.max("block"), F.lit(-1))).first()
        rows = index.live("postings", where=wanted & F.col("block").between(low, high))
        hits = rows.join(asked, "term").join(chosen.select("query_no", "block"), ["query_no", "block"], "left_semi")
        sums = hits.groupBy("query_no", "doc_id", "terms").agg(F.sum(points(F.col("tf"), F.col("length"))).alias("score"), F.count("*").alias("found"))
        return sums.where("found = terms").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_no", "rank", "doc_id", "score")

    few = bounds.withColumn("_n", F.row_number().over(promising)).where(F.col("_n") <= FIRST_BLOCKS).select("query_no", "block").checkpoint()
    reached = scored(few).where(F.col("rank") == k).select("query_no", F.col("score").alias("least"))
    # A little below, so that rounding in another order of addition leaves out no tie.
    rest = bounds.join(reached, "query_no", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9))
    return scored(rest.select("query_no", "block").checkpoint())
