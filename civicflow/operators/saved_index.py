"""A saved TF-IDF index that grows by appends.

Stored are counts, never weights: (doc_id, term, tf) of every document, and the document frequencies and number of
documents that each batch adds. All are sums over batches, so an append writes what is new and nothing is
rebuilt; idf is applied when the index is read, from the merged counts of one version. Tables of committed batches
(``sources.batch_table``) hold them; the one of batch sizes is the list of versions: postings and frequencies
of a batch count only once its size is committed, so a stopped append leaves no trace and a repeated one adds
nothing.

Postings are kept as packed blocks (``tfidf.pack``), each with all postings of some documents: an append packs its
texts where they are read, and moves none of them.

A reader that scores few texts at a time (a stream's micro-batch) loads the postings of their terms only; the
documents' norms, which depend on all terms and on the version's idf, are computed once a version and kept. So are
the blocks with norms and idf, for readers of many texts.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.operators.common import broadcast_checked
from civicflow.functions.text import tokens
from civicflow.operators import tfidf
from civicflow.operators.tfidf import TfidfIndex
from civicflow.session import cut_lineage
from civicflow.sources.batch_table import BatchTable

POSTINGS = "term string, doc_id long, tf double"
FREQUENCIES = "term string, df long"
SIZES = "n_docs long"
NORMS = "doc_id long, norm double"


@dataclass
class Version:
    """What a reader sees: the committed sizes, and the snapshots of the tables that they name parts of."""
    sizes: dict
    postings: dict
    frequencies: dict

    def live(self) -> dict:
        """The batches that no later one replaced."""
        gone = {b for m in self.sizes.values() for b in m["replaces"]}
        return {b: m for b, m in self.sizes.items() if b not in gone}

    @property
    def n_docs(self) -> int:
        """The sizes stand in the markers, so no job is needed."""
        return sum(m["n_docs"] for m in self.live().values())

    @property
    def name(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.live())).encode()).hexdigest()[:32]


class PackedPostings(BatchTable):
    """Postings that are written and read as rows (term, doc_id, tf), and stand in packed blocks of whole documents."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, POSTINGS)

    def stage(self, df: DataFrame) -> str:
        return self.stage_blocks(tfidf.packed_rows(df))

    def stage_blocks(self, blocks: DataFrame) -> str:
        folder = f"parts/{uuid.uuid4().hex}"
        blocks.write.parquet(f"{self.path}/{folder}")
        return folder

    def staged(self, *folders: str) -> DataFrame:
        return self.spark.read.schema(tfidf.PIECES).parquet(*folders) if folders else self.spark.createDataFrame([], tfidf.PIECES)

    def blocks(self, snapshot: dict[str, dict]) -> DataFrame:
        return self.staged(*self.folders(snapshot))

    def read(self, snapshot: dict[str, dict] | None = None) -> DataFrame:
        return tfidf.listed_postings(self.staged(*self.folders(snapshot)))


class SavedIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings = PackedPostings(spark, f"{path}/postings")
        self.frequencies = BatchTable(spark, f"{path}/frequencies", FREQUENCIES)
        self.sizes = BatchTable(spark, f"{path}/sizes", SIZES)
        self.norms = BatchTable(spark, f"{path}/norms", NORMS)
        self.packs = BatchTable(spark, f"{path}/packs", tfidf.WEIGHED)

    def version(self) -> Version:
        """The index as committed now; later appends do not change what is read through it."""
        return Version(sizes=self.sizes.snapshot(), postings=self.postings.snapshot(), frequencies=self.frequencies.snapshot())

    def append(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> bool:
        """Add the documents whose id the index does not have, as one batch; False if the batch is there already.

        Of rows with one id the smallest text counts; rows without an id or a text are left out.
        """
        if self.sizes.is_committed(batch):
            return False
        now = self.version()
        rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
        # the ids alone tell what is new, so that texts need not move: few ids that are to be left out are broadcast
        ids = cut_lineage(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
        if not ids.where(F.col("n") > 1).isEmpty():
            rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
        if now.sizes:
            known = ids.select("doc_id").join(tfidf.listed_docs(self._blocks(now)), "doc_id", "left_semi")
            rows = rows.join(broadcast_checked(cut_lineage(known)), "doc_id", "left_anti")
        return self._add(tfidf.packed_where_read(rows.select("doc_id", tokens("text").alias("terms"))), batch, [])

    def compact(self, batch: str) -> bool:
        """Merge all batches into one that replaces them; versions taken before stay readable."""
        now = self.version()
        if self.sizes.is_committed(batch) or len(now.live()) < 2:
            return False
        return self._add(self._blocks(now), batch, list(now.live()))

    def _add(self, blocks: DataFrame, batch: str, replaces: list[str]) -> bool:
        # parts get names of their own: those of an append that was stopped before its size was committed stay unused
        parts = {"postings": self.postings.stage_blocks(blocks)}
        written = self.postings.staged(f"{self.postings.path}/{parts['postings']}")
        n_docs = written.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        parts["frequencies"] = self.frequencies.stage(tfidf.listed_terms(written).groupBy("term").agg(F.sum("n").alias("df")))
        for name, table in (("postings", self.postings), ("frequencies", self.frequencies)):
            folder, parts[name] = parts[name], parts[name].rsplit("/", 1)[1]
            table.commit(folder, parts[name])
        size = self.sizes.stage(self.spark.range(1).select(F.lit(n_docs).alias("n_docs")))
        return self.sizes.commit(size, batch, replaces=replaces, n_docs=n_docs, parts=parts)

    def _part(self, snapshot: dict, name: str, version: Version) -> dict:
        return {m["parts"][name]: snapshot[m["parts"][name]] for m in version.live().values()}

    def _blocks(self, version: Version) -> DataFrame:
        return self.postings.blocks(self._part(version.postings, "postings", version))

    def _counts(self, version: Version) -> DataFrame:
        return self.postings.read(self._part(version.postings, "postings", version))

    def _frequencies(self, version: Version) -> DataFrame:
        return (self.frequencies.read(self._part(version.frequencies, "frequencies", version))
                .groupBy("term").agg(F.sum("df").alias("df")))

    def load(self, version: Version | None = None, terms: DataFrame | None = None) -> TfidfIndex:
        """The index of a version, as ``tfidf.build_index`` would give it for all its documents.

        With ``terms`` (distinct values of a column ``term``) only their postings are read, with weights that are
        divided by the documents' kept norms already.
        """
        version = self.version() if version is None else version
        n = float(version.n_docs)
        vocab = self._frequencies(version).select("term", tfidf.smooth_idf(n).alias("idf"))
        n_docs = self.spark.range(1).select(F.lit(n).alias("n"))
        counts = self._counts(version)
        if terms is not None:
            vocab = vocab.join(broadcast_checked(terms), "term", "left_semi")
            counts = counts.join(broadcast_checked(terms), "term", "left_semi")
        postings = counts.join(vocab, "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("w"))
        if terms is None:
            return TfidfIndex(postings, vocab, n_docs)
        postings = (postings.join(self.document_norms(version), "doc_id")
                    .select("term", "doc_id", (F.col("w") / F.col("norm")).alias("w")))
        return TfidfIndex(postings, vocab, n_docs, unit_docs=True)

    def document_norms(self, version: Version) -> DataFrame:
        """(doc_id, norm) of a version's documents, computed at its first use."""
        if not self.norms.is_committed(version.name):
            whole = self.load(version)
            self.norms.append(whole.postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), version.name)
        snapshot = self.norms.snapshot()
        return self.norms.read({version.name: snapshot[version.name]})

    def packed(self, version: Version | None = None) -> TfidfIndex:
        """The index of a version with its blocks weighed, at its first use: for searches of many texts."""
        version = self.version() if version is None else version
        whole = self.load(version)
        if not self.packs.is_committed(version.name):
            blocks = self._blocks(version)
            seen = tfidf.listed_terms(blocks).join(whole.vocab, "term").select("cb", "place", "idf")
            self.packs.append(tfidf.weighed(blocks, seen), version.name)
        snapshot = self.packs.snapshot()
        return replace(whole, weighed=self.packs.read({version.name: snapshot[version.name]}))
