"""TF-IDF index and sparse cosine top-k (A7, A8, J8, M2, M5 default encoder).

Weights follow the common "smooth idf" convention:
``idf = ln((1 + n) / (1 + df)) + 1``, ``w = tf * idf``, rows L2-normalised.
(MLlib's ``IDF`` omits the ``+ 1``, so it is only used inside the MLlib
classifiers, never for retrieval scores.)

The index is a long table ``(term, doc, w)``; queries get postings with the
same IDF. Scoring is exact and blocked (``search``): queries are hashed into
``qb`` blocks and documents into ``cb`` blocks, and each (qb, cb) cogroup task
accumulates the sparse product of its two posting sets into a bounded dense
score block with numpy, keeping only its local top-k. A join on ``term``
would instead emit one row per (query, doc, shared term), which for hot
terms ("the", "de") is every pair in the group; here no pair row is ever
shuffled, and every task's memory is bounded by the block sizes. A final
``row_number() <= k`` merges the ``cb`` local lists per query.

An index that was built from texts is packed for the search (``pack``): a
task turns its texts into compressed arrays of numbers, one piece a document
block, so that texts are tokenised once and a posting takes some two bytes
instead of a row each time it moves. Only a block's distinct terms go through
a shuffle by term, to get their document frequencies.

``cosine_scores`` keeps the plain join form as a small brute-force reference.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions.text import tokens
from civicflow.operators.common import block_partitions, top_k_per_group
from civicflow.session import cut_lineage

# Scores are ordered after rounding to this many places, so two engines (or two
# summation orders) that differ only in the last bits still break ties by id.
ORDER_DECIMALS = 9


@dataclass
class TfidfIndex:
    postings: DataFrame   # term, doc_id, w = tf * idf (not yet normalised)
    vocab: DataFrame      # term, idf
    n_docs: DataFrame     # one row: n
    unit_docs: bool = False  # are the weights divided by the documents' norms already?
    texts: DataFrame | None = None   # doc_id, terms: what the postings were built from, a row a text
    blocks: DataFrame | None = None  # the texts packed (see ``pack``)
    weighed: DataFrame | None = None  # packed blocks of all terms, by their names, with idf and norms

    def normalised(self) -> DataFrame:
        """Postings with L2-normalised weights (term, doc_id, w)."""
        return self.postings if self.unit_docs else _normalise(self.postings, "doc_id")


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) from whole texts."""
    return (df.select(F.col(id_col).alias("doc_id"), F.explode(tokens(text_col)).alias("term"))
            .groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))


def _normalise(weighted: DataFrame, id_col: str) -> DataFrame:
    norms = weighted.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return (weighted.join(norms, id_col)
            .withColumn("w", F.col("w") / F.col("_norm")).drop("_norm"))


def build_index(docs: DataFrame, id_col: str, text_col: str) -> TfidfIndex:
    """Fit the vocabulary/IDF on ``docs`` and return normalised postings."""
    tf = term_counts(docs, id_col, text_col)
    n_docs = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Documents with tf > 0 (all of them): the predicate keeps tf referenced,
    # so the (doc, term) aggregate below stays identical to the one the
    # weights use and its shuffle is reused. With count(1) (or count(tf),
    # which Catalyst folds to it) the aggregate becomes a distinct and every
    # text is tokenised twice.
    vocab = (tf.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, F.lit(1))).cast("double").alias("df"))
             .join(F.broadcast(n_docs), how="inner")   # one-row scalar
             .select("term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
                     .alias("idf")))
    weighted = tf.join(vocab, "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("w"))
    # Normalisation happens where the weights are used: the blocked scorer
    # holds every posting of a document in one task, so it needs no shuffle.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens(text_col).alias("terms"))
    return TfidfIndex(weighted, vocab, n_docs, texts=texts)


def transform_queries(index: TfidfIndex, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Query postings (term, query_id, w = tf * idf) with the index's IDF;
    unknown terms dropped (so the norm covers known terms only)."""
    return weigh_queries(index, term_counts(queries, id_col, text_col).withColumnRenamed("doc_id", "query_id"))


def weigh_queries(index: TfidfIndex, counts: DataFrame) -> DataFrame:
    """Query postings of term counts (query_id, term, tf)."""
    return counts.join(index.vocab, "term").select("term", "query_id", (F.col("tf") * F.col("idf")).alias("w"))


def cosine_scores(index: TfidfIndex, query_postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for every pair sharing at least one term.

    Plain join form, kept as a brute-force reference for small inputs."""
    q = _normalise(query_postings, "query_id").select("term", "query_id", F.col("w").alias("wq"))
    d = index.normalised().select("term", "doc_id", F.col("w").alias("wd"))
    return (q.join(d, "term")
            .groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score")))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best k docs per query: score desc (rounded for ordering), doc_id asc."""
    return top_k_per_group(scores, ["query_id"],
                           [F.round("score", ORDER_DECIMALS).desc(), F.col("doc_id").asc()], k)


# Block sizes bound the postings a task receives; inside a task the doc block
# is scored in slices of SLICE_ENTRIES scores, expanding at most EXPAND_CHUNK
# (query posting, doc posting) products at once.
MAX_QUERY_BLOCK = 100_000   # documents' postings are sent once per query block
MAX_DOC_BLOCK = 7_000
SLICE_QUERIES = 2_000       # queries of a block that are scored at once
SLICE_ENTRIES = 2_000_000   # score-matrix entries held at once inside a task
EXPAND_CHUNK = 100_000
# A shared term is "hot" when expanding its pairs would cost more than one
# dense rank-1 update of the block (an expanded pair takes some 10 ns, a dense
# one 0.03 ns where it was measured; 250 to 600 did best over whole blocks).
DENSE_COST_RATIO = 300
DENSE_COLUMNS = 512
PACK_ROWS = 300_000         # query postings that are packed together
NORM_CODE = -1              # in place of a term's number: the row holds a document's norm


def block_counts(n_queries: int, n_docs: int, max_q: int, max_d: int, target_tasks: int) -> tuple[int, int]:
    """(query blocks, doc blocks). Each doc block is shipped once per query
    block and each query block once per doc block; documents are the larger
    side, so extra parallelism comes from splitting documents further."""
    q_blocks = max(1, math.ceil(n_queries / max_q))
    c_blocks = max(1, math.ceil(n_docs / max_d), math.ceil(target_tasks / q_blocks))
    return q_blocks, c_blocks


def _scorer(k: int):
    """The best ``k`` documents of a block for each of its queries, from both sides' postings as arrays."""
    # Self-contained closure (numpy only): executors need not import us.
    order_decimals, expand_chunk = ORDER_DECIMALS, EXPAND_CHUNK
    dense_ratio, dense_cols, slice_entries, slice_queries = DENSE_COST_RATIO, DENSE_COLUMNS, SLICE_ENTRIES, SLICE_QUERIES

    def top_rows(s, qids, dids, kk):
        kk = min(kk, s.shape[1])
        thr = s.max(axis=1) if kk == 1 else np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
        # candidates: what may round to the row's k-th best or above (ties included), scored
        least = np.maximum(thr - 1.5 * 10.0 ** -order_decimals, np.nextafter(0, 1))
        qi_c, dj_c = np.nonzero(s >= least[:, None])
        rc = np.round(s[qi_c, dj_c], order_decimals)
        order = np.lexsort((dids[dj_c], -rc, qi_c))    # row, score desc, doc id
        qi_c, dj_c = qi_c[order], dj_c[order]
        rank = np.arange(len(qi_c)) - np.searchsorted(qi_c, qi_c, side="left")
        keep = rank < kk
        qi_c, dj_c = qi_c[keep], dj_c[keep]
        return qi_c.astype(np.int64), dids[dj_c], s[qi_c, dj_c]

    def slice_scores(nq, nt, qc, qi, qw, q_cnt, dc, di, dw, nd):
        """Dense (nq, nd) cosine block; postings sorted by term code."""
        scores = None
        d_cnt = np.bincount(dc, minlength=nt)
        d_start = np.cumsum(d_cnt) - d_cnt
        # Hot terms (many postings on both sides) go through a dense BLAS
        # product: cost nq*nd per term instead of far more per expanded pair.
        hot = q_cnt * d_cnt * dense_ratio > nq * nd
        hot_terms = np.nonzero(hot)[0]
        if len(hot_terms):
            col = np.full(nt, -1, dtype=np.int64)
            for lo in range(0, len(hot_terms), dense_cols):
                chunk = hot_terms[lo:lo + dense_cols]
                col[:] = -1
                col[chunk] = np.arange(len(chunk))
                qm, dm = col[qc] >= 0, col[dc] >= 0
                qd = np.zeros((nq, len(chunk)))
                dd = np.zeros((len(chunk), nd))
                qd[qi[qm], col[qc[qm]]] = qw[qm]
                dd[col[dc[dm]], di[dm]] = dw[dm]
                scores = qd @ dd if scores is None else np.add(scores, qd @ dd, out=scores)
        scores = np.zeros((nq, nd)) if scores is None else scores
        # the others: every query posting meets the run of its term's document postings
        flat = scores.reshape(-1)
        rare = np.nonzero(~hot[qc] & (d_cnt[qc] > 0))[0]
        sizes = d_cnt[qc[rare]]
        cum = np.cumsum(sizes)
        lo = 0
        while lo < len(rare):
            base = cum[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(cum, base + expand_chunk, side="right")), lo + 1)
            p, sz, ends = rare[lo:hi], sizes[lo:hi], cum[lo:hi] - base
            lo = hi
            dpost = np.repeat(d_start[qc[p]] - (ends - sz), sz)
            dpost += np.arange(len(dpost))
            at = np.repeat(qi[p].astype(np.int64) * nd, sz)
            at += di[dpost]
            w = np.repeat(qw[p], sz)
            w *= dw[dpost]
            np.add.at(flat, at, w)
        return scores

    def score_queries(nt, qids, qc, qi, qw, doc_slices):
        """Best documents of the block for some of its queries: each slice keeps its own top-k, merged (exact)."""
        q_cnt = np.bincount(qc, minlength=nt)
        parts = [top_rows(slice_scores(len(qids), nt, qc, qi, qw, q_cnt, dc, di, dw, len(dids)), qids, dids, k)
                 for dids, dc, di, dw in doc_slices]
        qrow, drow, srow = (np.concatenate(x) for x in zip(*parts))
        if len(parts) > 1:
            order = np.lexsort((drow, -np.round(srow, order_decimals), qrow))
            qrow, drow, srow = qrow[order], drow[order], srow[order]
            keep = np.arange(len(qrow)) - np.searchsorted(qrow, qrow, side="left") < k
            qrow, drow, srow = qrow[keep], drow[keep], srow[keep]
        return qids[qrow], drow, srow

    def score(nt, queries, docs):
        """(query ids, document ids, scores). Both sides, which are emptied to free memory: ids, and for every posting
        its term (below ``nt``), the place of its id and its weight."""
        (qids, qc, qi, qw), (dids, dc, di, dw) = queries, docs
        queries.clear()
        docs.clear()
        # Both sides are cut into slices, postings sorted by (slice, term), so that memory stays ~ slice_entries doubles.
        nq = min(len(qids), slice_queries)
        nd = max(1, min(len(dids), slice_entries // nq))

        def cut(n, size, c, i, w):
            of = (i // size).astype(np.int32)
            order = np.lexsort((c, of))
            c, i, w, of = c[order], i[order], w[order], of[order]
            edges = np.searchsorted(of, np.arange(-(-n // size) + 1))
            return [(lo * size, slice(edges[lo], edges[lo + 1])) for lo in range(len(edges) - 1)], c, i, w

        q_cuts, qc, qi, qw = cut(len(qids), nq, qc, qi, qw)
        d_cuts, dc, di, dw = cut(len(dids), nd, dc, di, dw)
        doc_slices = [(dids[lo:lo + nd], dc[m], di[m] - lo, dw[m]) for lo, m in d_cuts]
        found = [score_queries(nt, qids[lo:lo + nq], qc[m], qi[m] - lo, qw[m], doc_slices) for lo, m in q_cuts]
        return tuple(np.concatenate(x) for x in zip(*found))
    return score


def _block_top_k(k: int):
    score, norm_code = _scorer(k), NORM_CODE

    def fn(key, qp: pd.DataFrame, dp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": qp["query_id"].iloc[:0], "doc_id": pd.Series([], dtype="int64"),
                              "score": pd.Series([], dtype="float64")})
        terms = dp["code"].to_numpy(np.int64) != norm_code
        if qp.empty or not terms.any():
            return empty
        dids, di = np.unique(dp["doc_id"].to_numpy(np.int64)[terms], return_inverse=True)
        dw = dp["w"].to_numpy(np.float64)[terms]
        if not terms.all():  # divide the norms out
            ids, norms = dp["doc_id"].to_numpy(np.int64)[~terms], dp["w"].to_numpy(np.float64)[~terms]
            order = np.argsort(ids)
            dw = dw / norms[order][np.searchsorted(ids[order], dids)][di]
        uniq, dc = np.unique(dp["code"].to_numpy(np.int64)[terms], return_inverse=True)
        nt = len(uniq)
        codes = qp["code"].to_numpy(np.int64)
        at = np.minimum(np.searchsorted(uniq, codes), nt - 1)
        met = uniq[at] == codes
        qids, qi = np.unique(qp["query_id"].to_numpy()[met], return_inverse=True)
        qc, qw = at[met], qp["w"].to_numpy(np.float64)[met]
        if not len(qids):
            return empty
        ids, docs, scores = score(nt, [qids, qc, qi, qw], [dids, dc, di, dw])
        return pd.DataFrame({"query_id": ids, "doc_id": docs, "score": scores})
    return fn


# Packed postings: a row a block (or a piece of one) with three columns of compressed Arrow batches.
#   docs: doc_id (ascending), and the norms once they are known
#   terms: term and its number n of postings; once weighed, the idf, and for the terms of given queries their code in place of the term
#   posts: by term, then by document: place of the document (as a difference within the term), tf
PIECES = "cb long, n_rows long, docs binary, terms binary, posts binary"
WEIGHED = "cb long, docs binary, terms binary, posts binary"


def _codec():
    """Functions that pack arrays into bytes and back, and postings into the three columns."""
    # Self-contained closures (numpy and pyarrow only): executors need not import us.
    def dump(**arrays) -> bytes:
        batch = pa.record_batch(list(arrays.values()), names=list(arrays))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        return out.getvalue().to_pybytes()

    def load(raw) -> dict:
        batch = pa.ipc.open_stream(raw).read_next_batch()
        return dict(zip(batch.schema.names, batch.columns))

    def small(x):  # whole numbers, and tf that are whole, as short ones
        return x.astype(np.int32) if np.array_equal(x, x.astype(np.int32)) else x

    def dump_posts(n, di, tf) -> bytes:
        step = np.diff(di, prepend=0).astype(np.int32)
        starts = (np.cumsum(n) - n)[n > 0]
        step[starts] = di[starts]
        return dump(step=step, tf=small(tf))

    def load_posts(raw, n):
        """(term, document, tf) of every posting, by their places."""
        posts = load(raw)
        step, total = posts["step"].to_numpy(), np.cumsum(posts["step"].to_numpy(), dtype=np.int64)
        starts = (np.cumsum(n) - n)[n > 0]
        total -= np.repeat(total[starts] - step[starts], n[n > 0])
        return np.repeat(np.arange(len(n), dtype=np.int32), n), total.astype(np.int32), posts["tf"].to_numpy().astype(np.float64)
    return dump, load, dump_posts, load_posts


def _pack_pieces(by_first: bool = False):
    """Rows (cb, doc_id, terms) to pieces: one for each block that a batch has documents of.

    With ``by_first`` pieces go by their first document (the ids must be distinct): they are whole blocks then."""
    dump, _, dump_posts, _ = _codec()

    def fn(batches):
        for batch in batches:
            cb = batch.column("cb").to_numpy().astype(np.int64)
            if not len(cb):
                continue
            ids, row_doc = np.unique(batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(), return_inverse=True)
            lists = batch.column("terms")
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            nt, nd = max(len(names), 1), len(ids)
            # (block, term, document) as one number; a token each, then a posting each
            key = np.repeat(cb * nt * nd + row_doc, sizes)
            key += code * nd
            key.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
            tf, key = np.diff(first, append=len(key)), key[first]
            for b in np.unique(cb):
                rows = cb == b
                mine = slice(*np.searchsorted(key, [b * nt * nd, (b + 1) * nt * nd]))
                of_term, doc = np.divmod(key[mine] - b * nt * nd, nd)
                present, n = np.unique(of_term, return_counts=True)
                docs = np.unique(row_doc[rows])
                yield pa.record_batch([
                    pa.array([ids[docs[0]] if by_first else b], pa.int64()), pa.array([int(rows.sum())], pa.int64()), pa.array([dump(doc_id=ids[docs])]),
                    pa.array([dump(term=names.take(pa.array(present)), n=n.astype(np.int32))]),
                    pa.array([dump_posts(n, np.searchsorted(docs, doc), tf[mine])])],
                    names=["cb", "n_rows", "docs", "terms", "posts"])
    return fn


def _merge_pieces():
    """The pieces of a block to one row; what several pieces have of a document is added up."""
    dump, load, dump_posts, load_posts = _codec()

    def fn(table):
        pieces = [(load(r["docs"])["doc_id"].to_numpy(), load(r["terms"]), r["posts"]) for r in table.select(["docs", "terms", "posts"]).to_pylist()]
        ids, place = np.unique(np.concatenate([d for d, _, _ in pieces]), return_inverse=True)
        coded = pa.concat_arrays([t["term"] for _, t, _ in pieces]).dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        nd, keys, tfs, at, to = len(ids), [], [], 0, 0
        for d, t, posts in pieces:
            term, doc, tf = load_posts(posts, t["n"].to_numpy().astype(np.int64))
            keys.append(code[at:at + len(t["n"])][term] * nd + place[to:to + len(d)][doc])
            tfs.append(tf)
            at, to = at + len(t["n"]), to + len(d)
        key, tf = np.concatenate(keys), np.concatenate(tfs)
        del keys, tfs
        order = np.argsort(key)
        key, tf = key[order], tf[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        key, tf = key[first], np.add.reduceat(tf, first) if len(first) else tf
        term, doc = np.divmod(key, nd)
        n = np.bincount(term, minlength=len(names))
        return pa.table({"cb": pa.array([table["cb"][0].as_py()], pa.int64()), "n_rows": pa.array([sum(table["n_rows"].to_pylist())], pa.int64()),
                         "docs": [dump(doc_id=ids)], "terms": [dump(term=names, n=n.astype(np.int32))], "posts": [dump_posts(n, doc, tf)]})
    return fn


def _list_terms():
    """Block rows to (cb, place of the term in it, term, n)."""
    _, load, _, _ = _codec()

    def fn(batches):
        for batch in batches:
            for r in batch.to_pylist():
                terms = load(r["terms"])
                size = len(terms["n"])
                for lo in range(0, size, 100_000):
                    part = slice(lo, min(lo + 100_000, size))
                    yield pa.record_batch([pa.array(np.full(part.stop - lo, r["cb"], np.int64)), pa.array(np.arange(lo, part.stop, dtype=np.int32)),
                                           terms["term"][part], terms["n"][part].cast(pa.int64())], names=["cb", "place", "term", "n"])
    return fn


def _weigh_block():
    """A block and its terms' (place, idf, code) to the block with norms; of the terms those with a code are kept, or all if there are no codes."""
    dump, load, dump_posts, load_posts = _codec()

    def fn(block, seen):
        r = block.to_pylist()[0]
        docs, terms = load(r["docs"])["doc_id"].to_numpy(), load(r["terms"])
        n, place = terms["n"].to_numpy().astype(np.int64), seen["place"].to_numpy()
        idf = np.zeros(len(n))
        idf[place] = seen["idf"].to_numpy()
        term, doc, tf = load_posts(r["posts"], n)
        norm = np.sqrt(np.bincount(doc, weights=(tf * idf[term]) ** 2, minlength=len(docs)))
        if "code" in seen.column_names:
            code = np.full(len(n), -1, np.int64)
            code[place] = seen["code"].fill_null(-1).to_numpy()
            kept, mine = code >= 0, (code >= 0)[term]
            terms, posts = dump(code=code[kept], n=n[kept].astype(np.int32), idf=idf[kept]), dump_posts(n[kept], doc[mine], tf[mine])
        else:
            terms, posts = dump(code=terms["term"], n=terms["n"], idf=idf), r["posts"]
        return pa.table({"cb": pa.array([r["cb"]], pa.int64()), "docs": [dump(doc_id=docs, norm=norm)], "terms": [terms], "posts": [posts]})
    return fn


def _list_postings():
    """Block rows to (term, doc_id, tf)."""
    _, load, _, load_posts = _codec()

    def fn(batches):
        for batch in batches:
            for r in batch.to_pylist():
                docs, terms = load(r["docs"])["doc_id"].to_numpy(), load(r["terms"])
                term, doc, tf = load_posts(r["posts"], terms["n"].to_numpy().astype(np.int64))
                for lo in range(0, len(term), 100_000):
                    part = slice(lo, lo + 100_000)
                    yield pa.record_batch([terms["term"].take(pa.array(term[part])), pa.array(docs[doc[part]]), pa.array(tf[part])],
                                          names=["term", "doc_id", "tf"])
    return fn


def _list_docs():
    """Block rows to (doc_id)."""
    _, load, _, _ = _codec()

    def fn(batches):
        for batch in batches:
            for raw in batch.column("docs").to_pylist():
                yield pa.record_batch([load(raw)["doc_id"]], names=["doc_id"])
    return fn


def _list_idf():
    """Weighed block rows to (code, idf)."""
    _, load, _, _ = _codec()

    def fn(batches):
        for batch in batches:
            for raw in batch.column("terms").to_pylist():
                terms = load(raw)
                yield pa.record_batch([terms["code"], terms["idf"]], names=["code", "idf"])
    return fn


def _pack_queries():
    """Rows (qb, query_id, norm, code, tf) to packs of a query block's postings: one for each block that so many rows
    of a task have queries of. Codes are numbers or the terms themselves."""
    dump, _, dump_posts, _ = _codec()
    most = PACK_ROWS

    def gathered(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def fn(batches):
        for batch in gathered(batches):
            qb, tf = batch.column("qb").to_numpy(), batch.column("tf").to_numpy()
            coded = batch.column("code").dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy()
            for b in np.unique(qb):
                m = np.flatnonzero(qb == b)
                ids, at, i = np.unique(batch.column("query_id").to_numpy()[m], return_index=True, return_inverse=True)
                m, i = m[order := np.lexsort((i, code[m]))], i[order]
                codes, n = np.unique(code[m], return_counts=True)
                norm = batch.column("norm").to_numpy()[np.flatnonzero(qb == b)][at]
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([dump(query_id=ids, norm=norm)]),
                                       pa.array([dump(code=names.take(pa.array(codes)), n=n.astype(np.int32))]), pa.array([dump_posts(n, i, tf[m])])],
                                      names=["qb", "queries", "terms", "posts"])
    return fn


def _packed_top_k(k: int):
    score = _scorer(k)
    _, load, _, load_posts = _codec()
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def fn(packs, blocks):
        found = [best(packs, blocks.slice(i, 1).to_pylist()[0]) for i in range(blocks.num_rows if packs.num_rows else 0)]
        return pa.concat_tables([schema.empty_table(), *found])

    def best(packs, r):
        none = schema.empty_table()
        docs, terms = load(r["docs"]), load(r["terms"])
        term, doc, tf = load_posts(r["posts"], terms["n"].to_numpy().astype(np.int64))
        if not len(terms["code"]):
            return none
        tf *= terms["idf"].to_numpy()[term]
        tf /= docs["norm"].to_numpy()[doc]
        idf = terms["idf"].to_numpy()
        ids, qi, qc, qw, known = [], [], [], [], 0
        for p in packs.select(["queries", "terms", "posts"]).to_pylist():
            mine, asked = load(p["queries"]), load(p["terms"])
            at = pc.index_in(asked["code"], value_set=terms["code"]).fill_null(-1).to_numpy()
            of_code, query, times = load_posts(p["posts"], asked["n"].to_numpy().astype(np.int64))
            met = (at >= 0)[of_code]
            at, query = at[of_code[met]], query[met]
            ids.append(mine["query_id"].to_numpy())
            qi.append(query + np.int32(known))
            qc.append(at.astype(np.int32))
            qw.append(times[met] * idf[at] / mine["norm"].to_numpy()[query])
            known += len(ids[-1])
        ids, qi, qc, qw = (np.concatenate(x) for x in (ids, qi, qc, qw))
        if not len(qi):
            return none
        qids, own = np.unique(ids, return_inverse=True)  # a query's postings may be in several packs
        met = np.zeros(len(qids), bool)
        met[own[qi]] = True
        qi = (np.cumsum(met) - 1).astype(np.int32)[own][qi]
        queries, documents = [qids[met], qc, qi, qw], [docs["doc_id"].to_numpy(), term, doc, tf]
        del qc, qi, qw, term, doc, tf
        found = score(len(terms["code"]), queries, documents)
        return pa.table(dict(zip(schema.names, found)), schema=schema)
    return fn


def pack(index: TfidfIndex, n_queries: int, n_docs: int | None = None) -> TfidfIndex:
    """The index with its texts packed into document blocks, in the shared checkpoint folder: tokenised once.

    Numbers of documents and queries (upper bounds) only size the blocks. An index without texts stays as it is."""
    if index.blocks is not None or index.weighed is not None or index.texts is None:
        return index
    spark = index.texts.sparkSession
    if n_docs is None:
        n_docs = index.texts.select("doc_id").count()
    _, c_blocks = block_counts(n_queries, n_docs, MAX_QUERY_BLOCK, MAX_DOC_BLOCK, 3 * spark.sparkContext.defaultParallelism)
    keyed = index.texts.select(F.pmod(F.xxhash64("doc_id"), F.lit(c_blocks)).alias("cb"), "doc_id", "terms")
    pieces = keyed.mapInArrow(_pack_pieces(), PIECES).repartition(c_blocks, "cb")
    blocks = cut_lineage(pieces.groupBy("cb").applyInArrow(_merge_pieces(), PIECES))
    return replace(index, blocks=blocks, n_docs=blocks.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("double").alias("n")))


def listed_terms(blocks: DataFrame) -> DataFrame:
    """(cb, place, term, n): the terms of packed blocks, their place there, and how many documents have them."""
    return blocks.select("cb", "terms").mapInArrow(_list_terms(), "cb long, place int, term string, n long")


def listed_postings(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of packed blocks."""
    return blocks.select("docs", "terms", "posts").mapInArrow(_list_postings(), "term string, doc_id long, tf double")


def listed_docs(blocks: DataFrame) -> DataFrame:
    return blocks.select("docs").mapInArrow(_list_docs(), "doc_id long")


def packed_where_read(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, terms) with distinct ids as packed blocks, each of one task's documents: no row is moved."""
    return texts.select(F.lit(0).cast("long").alias("cb"), "doc_id", "terms").mapInArrow(_pack_pieces(by_first=True), PIECES)


def packed_rows(postings: DataFrame) -> DataFrame:
    """Postings (term, doc_id, tf) as packed blocks."""
    lists = (postings.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("terms")))
    return packed_where_read(lists)


def weighed(blocks: DataFrame, seen: DataFrame) -> DataFrame:
    """Packed blocks with norms, given (cb, place, idf) of their terms, and for a part of the terms a code."""
    both = blocks.select("cb", "docs", "terms", "posts").groupBy("cb").cogroup(seen.groupBy("cb"))
    return both.applyInArrow(_weigh_block(), WEIGHED)


def smooth_idf(n: float) -> Column:
    return F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df").cast("double"))) + F.lit(1.0)


def packed_top_k(index: TfidfIndex, counts: DataFrame, codes: DataFrame, k: int, n_queries: int) -> DataFrame:
    """``blocked_top_k`` over a packed index, for term counts (query_id, term, tf)."""
    if index.weighed is not None:  # terms go by their names
        blocks, asked = index.weighed, counts.join(index.vocab, "term").withColumnRenamed("term", "code")
    else:
        seen = (listed_terms(index.blocks).withColumn("df", F.sum("n").over(Window.partitionBy("term")))
                .withColumn("idf", smooth_idf(index.n_docs.first()["n"])).join(codes, "term", "left").select("cb", "place", "idf", "code"))
        blocks = cut_lineage(weighed(index.blocks, seen))
        idf = blocks.select("terms").mapInArrow(_list_idf(), "code long, idf double").groupBy("code").agg(F.max("idf").alias("idf"))
        asked = counts.join(codes, "term").join(idf, "code")
    # a task takes as many blocks as together have a planned block's documents: each group is sent all packs of queries
    numbers = sorted(r["cb"] for r in blocks.select("cb").collect()) or [0]
    q_blocks, c_blocks = block_counts(n_queries, int(index.n_docs.first()["n"]), MAX_QUERY_BLOCK, MAX_DOC_BLOCK,
                                      3 * counts.sparkSession.sparkContext.defaultParallelism)
    c_blocks = min(c_blocks, len(numbers))
    group = F.pmod(F.array_position(F.array(*[F.lit(c).cast("long") for c in numbers]), F.col("cb")), F.lit(c_blocks)).cast("int")
    norms = asked.groupBy("query_id").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    qp = (asked.join(norms, "query_id").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
          .select("qb", "query_id", "norm", "code", "tf")
          .mapInArrow(_pack_queries(), "qb int, queries binary, terms binary, posts binary")
          .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    dp = blocks.withColumn("cb", group).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    qp, dp = block_partitions(qp, dp, q_blocks * c_blocks)
    local = qp.groupBy("qb", "cb").cogroup(dp.groupBy("qb", "cb")).applyInArrow(_packed_top_k(k), "query_id long, doc_id long, score double")
    return top_k(local, k)


def block_sides(index: TfidfIndex, query_postings: DataFrame, q_blocks: int,
                c_blocks: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(normalised query postings, document postings, document norms) with the blocks (qb, cb) that each is sent to;
    no norms if the documents' weights are divided by them already.

    A posting is sent only where its term is met: a document's posting to the query blocks that have the term, a
    query's posting to the document blocks that have it. A product needs both, so no score changes. The documents'
    norms, for which a task then lacks postings, go to it as rows of their own: postings stay as they lie, by
    term, until they are dealt to the blocks.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    qp = _normalise(query_postings, "query_id").select("query_id", "term", "w").withColumn("qb", block("query_id", q_blocks))
    dp = index.postings.select(F.col("doc_id").cast("long"), "term", "w").withColumn("cb", block("doc_id", c_blocks))

    def meet(side, keep, other, b):  # renamed throughout: each side's blocks come from the other
        there = other.select(F.col("term").alias("_term"), F.col(b).alias("_block")).distinct()
        return (side.join(there, F.col("term") == F.col("_term"))
                .select(F.col(keep[0]).alias(keep[0]), F.col("term").alias("term"), F.col("w").alias("w"),
                        F.col(keep[1]).alias(keep[1]), F.col("_block").alias(b)))
    norms = None
    if not index.unit_docs:
        norms = (dp.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w"))
                 .withColumn("cb", block("doc_id", c_blocks)).withColumn("qb", every(q_blocks)))
    return meet(qp, ("query_id", "qb"), dp, "cb"), meet(dp, ("doc_id", "cb"), qp, "qb"), norms


def blocked_top_k(index: TfidfIndex, query_postings: DataFrame, codes: DataFrame, k: int, n_queries: int,
                  n_docs: int) -> DataFrame:
    """Exact top-k cosine per query (pairs sharing no term are not scored).

    ``codes``: a number (``code``) for every term of the queries, from a table that stays as it is when read again.
    """
    q_blocks, c_blocks = block_counts(n_queries, n_docs, MAX_QUERY_BLOCK, MAX_DOC_BLOCK,
                                      3 * query_postings.sparkSession.sparkContext.defaultParallelism)
    qp, dp, norms = block_sides(index, query_postings, q_blocks, c_blocks)
    qp, dp = (side.join(codes, "term").select(id_col, "code", "w", "qb", "cb") for side, id_col in ((qp, "query_id"), (dp, "doc_id")))
    if norms is not None:
        dp = dp.unionByName(norms.withColumn("code", F.lit(NORM_CODE).cast("long")))
    qp, dp = block_partitions(qp, dp, q_blocks * c_blocks)
    schema = f"query_id {query_postings.schema['query_id'].dataType.simpleString()}, doc_id long, score double"
    local = qp.groupBy("qb", "cb").cogroup(dp.groupBy("qb", "cb")).applyInPandas(_block_top_k(k), schema)
    return top_k(local, k)


def search(index: TfidfIndex, queries: DataFrame, id_col: str, text_col: str, k: int = 1,
           n_docs: int | None = None, n_queries: int | None = None) -> DataFrame:
    """Top-k (query_id, doc_id, score, rank) for each query text.

    Identical query texts are scored once (keyed by their SHA-256) and the
    result is joined back: exact, and it removes repeated work when queries
    repeat (as "<place> <practice>" queries or short chat turns do). Block
    counts come from ``n_docs`` / ``n_queries`` (upper bounds are fine; they
    only size the blocks), or from count jobs when not given.
    """
    # Numbered once and written: distinct texts, the terms that they have, and their counts are as small as the queries.
    distinct = cut_lineage(queries.select(F.col(text_col).alias("_qtext")).where(F.col("_qtext").isNotNull()).distinct()
                           .withColumn("_qid", F.monotonically_increasing_id()))
    counts = cut_lineage(term_counts(distinct, "_qid", "_qtext").withColumnRenamed("doc_id", "query_id"))
    codes = cut_lineage(counts.select("term").distinct().withColumn("code", F.monotonically_increasing_id()))
    n_queries = distinct.count()  # at most what was given
    index = pack(index, n_queries, n_docs)
    if index.blocks is not None or index.weighed is not None:
        ranked = packed_top_k(index, counts, codes, k, n_queries)
    else:
        if n_docs is None:
            n_docs = index.postings.select("doc_id").distinct().count()
        ranked = blocked_top_k(index, weigh_queries(index, counts), codes, k, n_queries, n_docs)
    ranked = ranked.withColumnRenamed("query_id", "_qid")
    keys = distinct.select("_qid", F.sha2("_qtext", 256).alias("_qkey"))
    return (queries.select(F.col(id_col).alias("query_id"), F.sha2(F.col(text_col), 256).alias("_qkey"))
            .join(ranked.join(keys, "_qid").drop("_qid"), "_qkey").drop("_qkey"))
