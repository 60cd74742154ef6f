"""Best-fit packing of token pieces, certified by dual-feasible-function bounds, with exchanges."""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keyed, release, stage, table
from .textgrams import give_back

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Words that a worker keeps the ids of, about 200 bytes each: the first, and so the frequent ones; others are encoded again.
CACHED_WORDS = 400_000
#: Text that is tokenized at a time.
TEXT_BYTES = 8 << 20
#: A letter, then a mark that is neither a letter nor a digit nor an apostrophe.
MARKS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:%#*&$|()\[\]{}<>/\\+=\-_\"])"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """Token ids of texts, word by word.

    The tokenizer's pattern never spans white space and its normalizer works within words, so that
    the ids of a text are those of its words, one after another. Two more steps change no ids and
    leave fewer distinct words: A-Z in lower case (so does the normalizer), and a space before
    marks that follow a letter (there the pattern parts them anyway). Words of letters alone are
    one piece of the pattern each, whose last token ends a word; many are encoded as one text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't known."""
        out = {}
        letters, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, e in zip(part, self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False)):
                ids = np.asarray(e.ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group):
                    data, stops = ids.tobytes(), (4 * ends).tolist()
                    out.update((w, data[a:b]) for w, a, b in zip(group, [0, *stops], stops))
                else:  # a letter that the normalizer changes into more
                    others += group
        for at in range(0, len(others), 10_000):
            part = others[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                out[w] = np.asarray(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each begins and the last ends."""
        give_back()
        texts = texts.cast(pa.string()).fill_null("")
        simple = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r"\1 \2")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, simple)  # special tokens are found in the text as it is
        parted = pc.split_pattern(pc.replace_substring_regex(texts, r"[\n\t\r]", " "), " ")
        coded = parted.values[parted.offsets[0].as_py() : parted.offsets[-1].as_py()].dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = self._fresh([w for w in words if w not in self.known])
        ids = [self.known[w] if w in self.known else fresh[w] for w in words]
        if len(self.known) + len(fresh) <= CACHED_WORDS:
            self.known.update(fresh)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        at = np.asarray(coded.indices)
        many = size[at]
        ends = np.concatenate(([0], np.cumsum(many)))
        begins = (np.cumsum(size) - size)[at]
        out = flat[np.repeat(begins - ends[:-1], many) + np.arange(ends[-1])]
        return out, ends[np.asarray(parted.offsets) - parted.offsets[0].as_py()]


@functools.lru_cache(1)
def worker_coder(path: str, job: str) -> WordCoder:
    """One for all of a job's tasks in a worker, so that they share the known words; each job begins anew."""
    return WordCoder(path)


def tokenize_pieces(docs: DataFrame, *, id_col="doc_id", text_col="text", path: str | None = None, most=2048, end_id=0) -> DataFrame:
    """Each document's ids and the end id, in pieces of at most `most`: PIECE columns."""
    path, job, last = path or tokenizer_path(), uuid.uuid4().hex, np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = worker_coder(path, job)
        for batch in batches:
            ids, size = batch.column(0).to_pylist(), np.asarray(pc.binary_length(batch.column(1)).fill_null(0))
            group = (np.cumsum(size) // TEXT_BYTES).tolist()
            edges = [i for i in range(len(ids)) if not i or group[i] != group[i - 1]] + [len(ids)]
            for i, j in zip(edges, edges[1:]):
                flat, at = coder.encode(batch.column(1)[i:j])
                rows = []
                for d in range(i, j):
                    data = flat[at[d - i] : at[d - i + 1]].tobytes() + last
                    for k, b in enumerate(range(0, len(data), 4 * most)):
                        part = data[b : b + 4 * most]
                        rows.append((ids[d], k, b // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Bin of each item, and the number of bins. Free room is kept by amount, as bits of an integer."""
    bins, at, n, mask = np.empty(len(lengths), np.int64), [[] for _ in range(size + 1)], 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                mask ^= 1 << room
        else:
            room, b, n = size, n, n + 1
        bins[i], left = b, room - need
        if left:
            at[left].append(b)
            mask |= 1 << left
    return bins, n


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions.

    f_k keeps an item that is a multiple of size/(k+1) as it is and rounds others down to
    multiples of 1/k; g_e counts items above size-e whole, drops those below e, keeps the rest.
    """
    x = np.asarray(lengths, np.int64)
    if not len(x):
        return 0
    lens, counts = np.unique(x, return_counts=True)
    best = -(-int(x.sum()) // size)
    for k in range(1, 65):
        whole = lens * (k + 1) % size == 0
        best = max(best, -(-int((np.where(whole, lens * k, lens * (k + 1) // size * size) * counts).sum()) // (k * size)))
    for e in np.unique(lens[lens <= size // 2]).tolist():
        kept = np.where(lens > size - e, size, np.where(lens < e, 0, lens))
        best = max(best, -(-int((kept * counts).sum()) // size))
    return best


def pack_pieces(pieces: DataFrame, *, most=2048, part_rows=16_384, patience=2) -> DataFrame:
    """Place pieces in as few sequences as it can: adds sequence_id and offset.

    Pieces are dealt to partitions of about `part_rows` by their place in the table, so that no id
    makes a large one; each is packed by best-fit decreasing, and a dual-feasible bound certifies
    its number of bins. Where bins and bound differ, the bins that aren't full are dealt anew, again
    about `part_rows` pieces to a partition; each reruns best-fit decreasing and keeps the new bins
    if they are fewer, so that no round makes it worse. A full bin stays where it is. Rounds go
    on until no gap is left or `patience` in a row have closed nothing: gaps that then stay open
    may be real, as the bound is one. `bins` and `bound` tell how many sequences a piece's
    partition holds, and that no packing of its pieces has fewer than the bound.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = f"{PIECE}, part long, bin long, gap boolean, full boolean"

    def filled(rows: pd.DataFrame, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, rows["length"].to_numpy())[bins] == most

    def first(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names, kind="stable", ignore_index=True)
        lens = rows["length"].to_numpy()
        bins, used = best_fit_decreasing(lens, most)
        return rows[names].assign(part=key[0], bin=bins, gap=used > lower_bound(lens, most), full=filled(rows, bins))

    def exchange(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names, kind="stable", ignore_index=True)
        lens, old = rows["length"].to_numpy(), rows.groupby(["old", "bin"], sort=True).ngroup().to_numpy()
        bins, used = best_fit_decreasing(lens, most)
        if used >= old.max() + 1:
            bins, used = old, old.max() + 1
        return rows[names].assign(part=key[0], bin=bins, gap=used > lower_bound(lens, most), full=filled(rows, bins))

    pieces = keyed(pieces)
    parts = max(1, -(-pieces.count() // part_rows))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(parts)))
    placed = stage(dealt.groupBy("part").applyInPandas(first, schema), "packed-0")
    total, r, idle, fewest = parts, 0, 0, None
    while True:
        open_ = placed.where("gap AND NOT full")
        n, gaps, used = open_.agg(F.count("*"), F.count_distinct("part"), F.count_distinct("part", "bin")).first()
        idle, fewest, r = (0, (gaps, used), r + 1) if fewest is None or (gaps, used) < fewest else (idle + 1, fewest, r + 1)
        if gaps < 2 or idle >= patience:
            break
        groups = max(1, -(-n // part_rows))
        meet = (F.lit(total) + F.pmod(F.xxhash64(F.lit(r), "part", "bin"), F.lit(groups))).alias("part")
        moved = open_.select(*names, meet, F.col("part").alias("old"), "bin").groupBy("part").applyInPandas(exchange, schema)
        after = stage(placed.where("NOT gap OR full").unionByName(moved), f"packed-{r}")
        release(placed)
        placed, total = after, total + groups

    def offsets(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", *names], kind="stable", ignore_index=True)
        ends = rows.groupby("bin")["length"].cumsum()
        return rows[names].assign(sequence_id=(key[0] << 24) + rows["bin"], offset=ends - rows["length"], bins=rows["bin"].nunique(), bound=lower_bound(rows["length"].to_numpy(), most))

    done = placed.groupBy("part").applyInPandas(offsets, f"{PIECE}, sequence_id long, offset long, bins long, bound long")
    return done.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", "bins", "bound")


def pack_documents(docs: DataFrame, **columns) -> DataFrame:
    """Tokenize documents, cut those of over 2048 tokens, and pack the pieces.

    Null text is empty (its only token is the end id); null ids stay null; documents that repeat
    are packed as often; an empty table gives no rows; other columns are not looked at.
    """
    return pack_pieces(stage(tokenize_pieces(docs, **columns), "pieces"))


def op7_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
