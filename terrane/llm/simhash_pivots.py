"""SimHash near-duplicates with pivot distance tables (operator 5).

A fingerprint holds, per bit, the majority over the XXH64 values of a text's word shingles.
Each distinct fingerprint gets a row of Hamming distances to fixed reference fingerprints (the
pivots).  By the triangle inequality two fingerprints within r differ by at most r in every
coordinate, so the greatest coordinate difference discards most pairs; survivors are verified.

A join needs an equal key, so pairs meet through the pigeonhole principle: with six blocks of
bits and three differing bits, three blocks agree in full, and there are twenty such triples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm._graph import components
from terrane.llm._spark import forget, keep, lean, may_hold, whole_keys
from terrane.llm._text import Piece, U, as_bytes, mix, pieces

# XXH64 primes: fixed values of the hash's specification.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

#: Bytes of text whose sketches or shingles are laid out at once.
_BYTES = 512 << 10

#: Candidates that a member of a bucket names before what they tie is known; then it names all that are left.
_FIRST = 4

#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


@dataclass(frozen=True)
class SimHash:
    shingle: int = 3
    seed: int = 42
    radius: int = 3
    #: Of use at small radii only; with 0 the bits decide alone.
    pivots: int = 16


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U(k)) | (x >> U(64 - k))


def xxh64(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the stretches [start, end) of ``raw``."""
    size = end - start
    h = np.full(len(start), U(seed)) + P5 + size.astype(np.uint64)
    padded = raw + bytes(8)
    lane8 = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    lane4 = np.ndarray((len(raw) + 1,), "<u4", padded, strides=(1,))
    at = start.copy()
    for k in range(1, 4):
        i = np.flatnonzero((size >= 8 * k) & (size < 32))
        if len(i):
            x = h[i] ^ _turn(lane8[at[i]] * P2, 31) * P1
            h[i] = _turn(x, 27) * P1 + P4
            at[i] += 8
    i = np.flatnonzero((size & 4 > 0) & (size < 32))
    x = h[i] ^ lane4[at[i]].astype(np.uint64) * P1
    h[i] = _turn(x, 23) * P2 + P3
    at[i] += 4
    data = np.frombuffer(padded, np.uint8)
    for k in range(1, 4):
        i = np.flatnonzero(((size & 3) >= k) & (size < 32))
        x = h[i] ^ data[at[i]].astype(np.uint64) * P5
        h[i] = _turn(x, 11) * P1
        at[i] += 1
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    h ^= h >> U(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]], seed)
    return h


def _votes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Set bits per position (64 columns) in each run of ``h`` from ``first`` to the next; runs aren't empty."""
    size = np.diff(np.append(first, len(h)))
    parts = -(-size // 255)  # a byte lane counts to 255
    run = np.cumsum(parts) - parts
    cut = np.repeat(first - 255 * run, parts) + 255 * np.arange(parts.sum())
    out = np.empty((len(first), 64), np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> U(s)) & U(0x0101010101010101), cut)
        out[:, s::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run, axis=0)
    return out


def _shingles(run: list[bytes], how: SimHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the shingles of texts side by side, the text of each, and their number per text."""
    piece = Piece(run, lower=True)
    words = piece.words()
    keep_ = words.inside.copy()
    keep_[1:] |= words.inside[:-1]
    raw = np.where(words.inside, piece.data, np.uint8(32))[keep_].tobytes()
    end = np.cumsum(words.stop - words.start + 1) - 1
    begin = end - (words.stop - words.start)
    n = np.where(words.count > 0, np.maximum(1, words.count - how.shingle + 1), 0)
    text = np.repeat(np.arange(len(run)), n)
    head = np.arange(n.sum()) - (np.cumsum(n) - n)[text] + words.first[text]
    tail = np.minimum(head + how.shingle, words.first[text + 1]) - 1
    return xxh64(raw, begin[head], end[tail], how.seed), text, n


def _distinct(h: np.ndarray, text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of each text once, as ``_shingles`` returns them."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[first], text[first], np.bincount(text[first], minlength=len(n))


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    got = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = 2 * _votes(h, (np.cumsum(n) - n)[some]) > n[some, None]
        got[some] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1)
    return got


def fingerprints(texts: list[bytes | None], how: SimHash) -> np.ndarray:
    """64-bit fingerprint of each text; zero for a text without words."""
    out = [np.zeros(0, np.uint64)]
    for _, run in pieces(texts):
        h, _, n = _shingles(run, how)
        out.append(_majority(h, n))
    return np.concatenate(out)


def _pivot_table(fp: np.ndarray, pivots: int) -> np.ndarray:
    refs = mix(np.arange(1, pivots + 1, dtype=np.uint64))
    return np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) lie within the radius: pivot coordinates first, then the bits."""
    left = np.arange(len(i))
    for row in table:
        left = left[np.abs(row[i[left]] - row[j[left]]) <= radius]
    return left[np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= radius]


def bucket_edges(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, how: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each key, just what links within the radius connect there."""
    order = np.lexsort((fp, key))
    key, fp, rep = key[order], fp[order], rep[order]
    begin = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    table = _pivot_table(fp, how.pivots)
    a, b = [], []
    place = np.arange(len(key)) - np.repeat(begin, size)
    room = np.repeat(size, size)
    for d in range(1, 8):
        i = np.flatnonzero((place + d < room) & (room <= 8))
        i = i[_near(fp, table, i, i + d, how.radius)]
        a.append(rep[i])
        b.append(rep[i + d])
    for s, n in zip(begin[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        # grow one component after another; each member is compared with those not yet reached
        waiting = np.arange(s, s + n)
        while len(waiting) > 1:
            todo, waiting = [int(waiting[0])], waiting[1:]
            while todo and len(waiting):
                x = todo.pop()
                hit = _near(fp, table, np.full(len(waiting), x), waiting, how.radius)
                if len(hit):
                    found = waiting[hit]
                    a.append(np.full(len(found), rep[x]))
                    b.append(rep[found])
                    todo.extend(found.tolist())
                    waiting = np.delete(waiting, hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])


def print_links(reps: DataFrame, how: SimHash) -> DataFrame:
    """Links (a, b) that connect just the reps of fingerprints within the radius; ``reps`` is (fp, rep), a row for each fingerprint."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, 50_000):
            key, fp, rep = (c.to_numpy() for c in t.columns)
            a, b = bucket_edges(key, fp.view(np.uint64), rep, how)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    blocks = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1) for at, width in BLOCKS]
    keys = []
    for k, (x, y, z) in enumerate(combinations(range(6), 3)):
        v = F.lit(k).cast("long")
        for c in (x, y, z):
            v = v * (1 << BLOCKS[c][1]) + blocks[c]
        keys.append(v)
    buckets = reps.where("rep is not null").select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")
    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(lean(edges), "a long, b long")


def simhash_components(docs: DataFrame, how: SimHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``; ids are integers.

    ``component_id`` is the least id reachable through links of at most ``radius`` differing
    bits.  Null, empty and word-free texts have fingerprint zero and link like any other;
    repeated rows each get a row; a null id never names a component; other columns are not
    read; an empty table gives an empty one.
    """
    how = how or SimHash()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(as_bytes(b.column(1)), how).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    all_ = keep(docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(prints, "id long, fp long"), "simhash")
    reps = all_.groupBy("fp").agg(F.min("id").alias("rep"))
    linked = components(print_links(reps, how))
    named = reps.join(linked, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return all_.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Similar:
    """Links by the similarity of shingle sets, of pairs that fingerprints or bands bring together.

    Fingerprints meet as in operator 5 (``prints``): by bit blocks, pivot table and bits.  Those of
    texts that share four fifths of their shingles differ in ten bits and more, too many for the
    pigeonhole principle to find pairs.  So the other pairs meet through bands of
    least shingle hashes; the bits of ``how`` then discard those beyond its radius, at which a pivot
    table, of use for ``prints``, would discard none.  Each distinct shingle votes once, so repeats move no bit: a bit of two sets that share four
    fifths differs with a chance of 0.1875 at most (four shingles and five), and more than 32 of
    64 do in less than one pair of a hundred million.  A sketch of ``bins`` least hashes, whose
    estimate has a deviation of sqrt(s(1 - s) / bins), passes candidates from ``candidate`` on,
    and the distinct shingles of a candidate pair decide.
    """

    how: SimHash = SimHash(shingle=5, radius=32, pivots=0)
    #: How fingerprints meet.
    prints: SimHash = SimHash(shingle=5)
    similarity: float = 0.8
    candidate: float = 0.7
    bins: int = 512
    bands: int = 20
    rows: int = 4
    #: Larger buckets are searched in blocks, in turns, instead of listing their pairs.
    bucket: int = 32
    block: int = 256


def _set_hash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of each set of shingles, from all of them."""
    got = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        got[some] = np.add.reduceat(mix(h + U(1)), (np.cumsum(n) - n)[some])
    return mix(got + n.astype(np.uint64))


def measures(texts: list[bytes | None], s: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, hash of the set of shingles, sketch, band keys) of each text.

    A shingle's hash falls into one of ``bins``; the sketch has a byte of the least hash of each
    bin, 0 if the bin is empty.  Bands take ``rows`` bins each, an empty one borrowing from the
    next that is not (Shrivastava and Li 2014).  Texts are taken 512 at a time, since the
    sketches of very short ones outgrow their text.
    """
    fp, same, sketch, bands = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((0, s.bins), np.uint8)], [np.zeros((0, s.bands), np.uint64)]
    for _, run in pieces(texts, limit=_BYTES, most=512):
        h, text, n = _distinct(*_shingles(run, s.how))
        fp.append(_majority(h, n))
        same.append(_set_hash(h, n))
        x = mix(h)
        least = np.full(len(run) * s.bins, U((1 << 64) - 1))
        np.minimum.at(least, text * s.bins + ((x >> U(32)) % U(s.bins)).astype(np.int64), mix(x))
        least = least.reshape(len(run), s.bins)
        empty = least == U((1 << 64) - 1)
        sketch.append(np.where(empty, 0, least % U(255) + U(1)).astype(np.uint8))
        place = np.where(empty, 2 * s.bins, np.arange(s.bins))
        after = np.minimum.accumulate(np.concatenate([place, place + s.bins], axis=1)[:, ::-1], axis=1)[:, ::-1][:, : s.bins]
        gap = (after - np.arange(s.bins)).astype(np.uint64)
        full = mix(np.take_along_axis(least, after % s.bins, axis=1) + gap * U(0x9E3779B97F4A7C15))
        key = np.zeros((len(run), s.bands), np.uint64)
        spread = np.arange(s.bands * s.rows) * s.bins // (s.bands * s.rows)  # far apart, so that few borrow the same
        for r in range(s.rows):
            key = mix(key * U(31) + full[:, spread[r :: s.rows]])
        bands.append(mix(key + np.arange(s.bands, dtype=np.uint64)))
    return np.concatenate(fp), np.concatenate(same), np.concatenate(sketch), np.concatenate(bands)


def sketches(texts: list[bytes | None], s: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, sketch, band keys) of each text."""
    fp, _, sketch, bands = measures(texts, s)
    return fp, sketch, bands


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of sketches; two without a shingle are alike."""
    some = np.maximum(1, ((a > 0) | (b > 0)).sum(axis=-1))
    none = ~((a > 0) | (b > 0)).any(axis=-1)
    return np.where(none, 1.0, ((a == b) & (a > 0)).sum(axis=-1) / some)


def _bucket_pairs(key: np.ndarray, fp: np.ndarray, how: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of each small bucket that the bits (and pivots, if ``how`` has any) don't discard."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    table = _pivot_table(fp, how.pivots)
    a, b, d = [order[:0]], [order[:0]], 1
    while d < len(key) and len(i := np.flatnonzero(key[:-d] == key[d:])):
        i = i[_near(fp, table, i, i + d, how.radius)]
        a.append(order[i])
        b.append(order[i + d])
        d += 1
    return np.concatenate(a), np.concatenate(b)


def _grow(label: np.ndarray, fp: np.ndarray, sketch: np.ndarray, s: Similar) -> tuple[list[int], list[int]]:
    """Places of a spanning forest of the likely links between labels; pairs are not listed, and the same members give the same forest."""
    table = _pivot_table(fp, s.how.pivots)
    a, b = [], []
    waiting = np.arange(len(fp))
    while len(waiting) > 1:
        todo, waiting = [int(waiting[0])], waiting[1:]
        while todo and len(waiting):
            x = todo.pop(0)
            same = label[waiting] == label[x]
            hit = _near(fp, table, np.full(len(waiting), x), waiting, s.how.radius)
            hit = hit[~same[hit]]
            hit = hit[estimate(sketch[x][None], sketch[waiting[hit]]) >= s.similarity]
            a += [x] * len(hit)
            b += waiting[hit].tolist()
            reached = same
            reached[hit] = True
            todo.extend(waiting[reached].tolist())
            waiting = waiting[~reached]
    return a, b


def _best(seek: np.ndarray, label: np.ndarray, fp: np.ndarray, sketch: np.ndarray, keys: np.ndarray, band: int, s: Similar, most: int | None) -> tuple[list[int], list[int], bool]:
    """Places of the ``most`` (None: all) likeliest candidates of another label for each member that seeks, and whether there are more.

    Members that do not seek are those to meet; where all seek, they meet each other.  A pair
    that shares several bands is named in the first of these (``band`` is that of this bucket)
    and left to it in the others.
    """
    table = _pivot_table(fp, s.how.pivots)
    a, b, more = [], [], False
    alone = bool(seek.all())
    for x in np.flatnonzero(seek).tolist():
        other = np.flatnonzero((label != label[x]) & (alone | ~seek))
        if alone and most is None:  # the other one of two that seek names the pair
            other = other[other > x]
        if band:
            other = other[(keys[other, :band] != keys[x, :band]).all(axis=1)]
        other = other[_near(fp, table, np.full(len(other), x), other, s.how.radius)]
        alike = estimate(sketch[x][None], sketch[other])
        other, alike = other[alike >= s.candidate], alike[alike >= s.candidate]
        more |= most is not None and len(other) > most
        other = other[np.argsort(-alike, kind="stable")[:most]]
        a += [x] * len(other)
        b += other.tolist()
    return a, b, more


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first ``by`` columns; they come sorted by these."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(i).to_numpy() for i in range(by)])
        cut = (np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()
        if kept and any(kept[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(by)):
            yield pa.Table.from_batches(kept)
            kept = []
        for low, high in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            if low:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(low, high - low))
    if kept:
        yield pa.Table.from_batches(kept)


def _groups(members: DataFrame, turn: int, s: Similar) -> DataFrame:
    """(key, i, j, node, label, seek, full): groups of at most twice ``s.block`` members of each bucket (key, node, label).

    In the first turn a bucket falls into blocks; in the next ones a member of each label stands
    for it while these are too many for a block.  After that (``full``) all pairs of different
    labels share a group: those outside the most frequent label (``seek``) meet everyone.
    """
    per = members.groupBy("key", "label").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("root"))
    per = keep(per, "labels")
    size = per.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("major")).where("kinds > 1")
    few = F.col("n") <= s.block
    roots = (~few) & F.lit(0 < turn < 4) & (F.col("kinds") > s.block)
    full = F.lit(turn > 0) & ~roots
    size = keep(size.withColumns({"roots": roots, "full": full, "few": few}), "sizes")
    hashed = F.xxhash64("node", F.lit(turn + 1))

    def blocks(n: Column) -> Column:
        """A power of two, so that buckets of like sizes put the same members together and name the same pairs."""
        return F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(n / s.block)))).cast("long")

    def block(n: Column) -> Column:
        return F.pmod(hashed, blocks(n)).cast("long")

    m = members.join(size, "key")
    alone = block(F.when(F.col("few"), F.lit(1)).otherwise(F.col("n")))
    whole = m.where("not roots and (few or not full)").select("key", alone.alias("i"), alone.alias("j"), "node", "label", F.lit(True).alias("seek"), "full")
    stand = per.join(size.where("roots"), "key").select("key", F.col("root").alias("node"), "label", "kinds", "full")
    stand = stand.select("key", block(F.col("kinds")).alias("i"), block(F.col("kinds")).alias("j"), "node", "label", F.lit(True).alias("seek"), "full")
    rest = F.col("n") - F.col("most")
    large = m.where("full and not few")
    seek = large.where("label <> major").select("key", block(rest).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col("n")) - 1)).alias("j"), "node", "label", F.lit(True).alias("seek"), "full")
    meet = large.select("key", F.explode(F.sequence(F.lit(0).cast("long"), blocks(rest) - 1)).alias("i"), block(F.col("n")).alias("j"), "node", "label", F.lit(False).alias("seek"), "full")
    return whole.union(stand).union(seek).union(meet)


def similar_components(docs: DataFrame, s: Similar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row of ``docs`` with integer ids, by ``Similar``; odd rows as in ``simhash_components``."""
    return _similar(docs, s, id_col, text_col).select(F.col("id").alias(id_col), "component_id")


def _similar(docs: DataFrame, s: Similar | None, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, component_id) for each row."""
    s = s or Similar()
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, same, sketch, bands = measures(as_bytes(b.column(1)), s)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), s.bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(same.view(np.int64)), pa.array(fp.view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), lists], ["id", "text_hash", "node", "fp", "sketch", "keys"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, 10_000):
            key, fp, node = (t.column(i).to_numpy() for i in range(3))
            sketch = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, s.bins)
            i, j = _bucket_pairs(key, fp.view(np.uint64), s.how)
            yes = np.concatenate([np.zeros(0, bool), *(estimate(sketch[i[k : k + 4096]], sketch[j[k : k + 4096]]) >= s.candidate for k in range(0, len(i), 4096))])
            a, b = node[i[yes]], node[j[yes]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def propose(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _runs(batches, 3):
                t = t.sort_by("node")
                node, label, fp = (t.column(i).to_numpy() for i in (3, 4, 7))
                sketch = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint8).reshape(-1, s.bins)
                more = True
                if t.column(6)[0].as_py():
                    keys = t.column(9).combine_chunks().flatten().to_numpy().reshape(-1, s.bands)
                    band = int(np.flatnonzero(keys[0] == t.column(0)[0].as_py())[0])
                    a, b, more = _best(t.column(5).to_numpy(), label, fp.view(np.uint64), sketch, keys, band, s, _FIRST if turn < 2 else None)
                else:
                    a, b = _grow(label, fp.view(np.uint64), sketch, s)
                x, y = node[np.array(a, np.int64)], node[np.array(b, np.int64)]
                key = t.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(a) + [key] * more, pa.int64()), pa.array([*np.minimum(x, y).tolist(), *[None] * more], pa.int64()), pa.array([*np.maximum(x, y).tolist(), *[None] * more], pa.int64())], ["key", "a", "b"])

        return run

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, run in pieces(as_bytes(batch.column(0)), limit=_BYTES):
                h, text, n = _distinct(*_shingles(run, s.how))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(h, n).view(np.int64)), lists], ["node", "hashes"])

    hashed = d.select("id", "text", F.xxhash64("text").alias("text_hash"))
    all_ = keep(hashed.mapInArrow(lean(measure), "id long, text_hash long, node long, fp long, sketch binary, keys array<long>"), "sketches")
    names = all_.where("id is not null").groupBy("node").agg(F.min("id").alias("rep"))
    own = all_.join(names, (F.col("id") == F.col("rep")) & (all_["node"] == names["node"]), "left_semi").dropDuplicates(["node"])
    reps = keep(own.select("node", F.col("id").alias("rep"), "fp", "sketch", "keys"), "representatives")
    plain = reps.select("node", "fp", "sketch")

    rows = reps.select(F.explode("keys").alias("key"), "node")
    sizes = rows.groupBy("key").count().where("count > 1").select("key", (F.col("count") > s.bucket).alias("large"))
    sizes = keep(sizes, "buckets")
    met = keep(rows.join(sizes, "key"), "members")
    forget(sizes)
    # sets of one fingerprint, and fingerprints within the radius of ``prints``, whatever bands they share
    heads = keep(reps.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    near = reps.select("fp", "node").join(heads, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).union(print_links(heads, s.prints))
    near = keep(near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")  # blocks of zeros can meet themselves
    forget(heads)
    # the shingles of every text that meets another, once for all turns
    meets = met.select("node").union(near.select("a")).union(near.select("b"))
    want = keep(meets.distinct().join(reps.select("node", "rep"), "node"), "wanted")
    texts = may_hold(d, F.col("id"), want.select("rep")).where("__may").join(want.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("text")
    sets = keep(texts.mapInArrow(lean(hashes), "node long, hashes array<long>").join(want.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")
    forget(want)

    def similar(found: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that share ``similarity`` of their distinct shingles."""
        # only sets of these pairs are moved
        x, y = (may_hold(sets, F.col("node"), found.select(c)).where("__may").select(F.col("node").alias(c), F.col("hashes").alias(h)) for c, h in (("a", "x"), ("b", "y")))
        shared = F.size(F.array_intersect("x", "y"))
        both = found.join(x, "a").join(y, "b").select("a", "b", shared.alias("n"), (F.size("x") + F.size("y") - shared).alias("of"))
        return keep(both.where(F.col("n") / F.col("of") >= s.similarity).select("a", "b"), "links")

    def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b) with the labels la and lb of both; a node without one is its own."""
        ends = found.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        return ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))

    def tied_by(links: DataFrame, labels: DataFrame) -> DataFrame:
        """The labels once links tie them; what they tie gets one label."""
        tied = components(labelled(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        known = labels.join(tied.withColumnRenamed("node", "tie"), F.col("label") == F.col("tie"), "left").select("node", F.coalesce("component", "label").alias("label"))
        return keep(known.union(tied.select("node", F.col("component").alias("label"))).distinct(), "labels")

    small = met.where("not large")
    small = small.join(may_hold(plain, F.col("node"), small.select("node")).where("__may").drop("__may"), "node").select("key", "fp", "node", "sketch")
    likely = keep(small.repartition("key").sortWithinPartitions("key").mapInArrow(lean(pairs), "a long, b long").distinct(), "candidates")
    links = similar(near)
    labels = keep(components(links).select("node", F.col("component").alias("label")), "labels")
    forget(near, links)
    # a pair for each member ties most of a group; of the others only those count that still lie apart
    apart = labelled(likely, labels).where("la <> lb").select("a", "b")
    first = keep(apart.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = similar(first)
    last, labels = labels, tied_by(links, labels)
    forget(links, last)
    others = labelled(likely.join(first, ["a", "b"], "left_anti"), labels).where("la <> lb").select("a", "b")
    links = similar(keep(others, "others"))
    last, labels = labels, tied_by(links, labels)
    forget(likely, first, links, last)
    large = keep(met.where("large").select("key", "node"), "large")
    left = keep(large.select("key").distinct(), "unsettled")
    mates = keep(may_hold(reps.select("node", "fp", "sketch", "keys"), F.col("node"), large.select("node")).where("__may").drop("__may"), "mates")
    forget(met)
    tried = None
    turn = 0
    while not left.isEmpty():
        members = keep(large.join(left, "key", "left_semi").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "members")
        groups = _groups(members, turn, s).join(mates if turn else mates.withColumn("keys", F.lit(None).cast("array<long>")), "node").select("key", "i", "j", "node", "label", "seek", "full", "fp", "sketch", F.when(F.col("full"), F.col("keys")).alias("keys"))
        found = keep(groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(propose(turn)), "key long, a long, b long"), "proposed")
        fresh = found.where("a is not null").select("a", "b").distinct()
        if tried is not None:
            fresh = fresh.join(tried, ["a", "b"], "left_anti")
        fresh = keep(fresh, "tried")
        links = similar(fresh)
        now = tied_by(links, labels)
        last, rest = left, keep(found.where("a is null").select("key").distinct(), "unsettled")
        forget(members, found, links, labels, last)
        labels, left = now, rest
        tried = fresh if tried is None else keep(tried.union(fresh), "tried")
        turn += 1
    ids = names.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = keep(ids.join(least, "component").select("node", "component_id"), "named")
    return all_.select("id", "text_hash", "node").join(named, "node", "left").select("id", "text_hash", "component_id")


def keep_one(docs: DataFrame, s: Similar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar texts, one of the least id, all columns unchanged.

    Rows that share an id are told apart by their text; rows of a null id all stay.
    """
    found = keep(_similar(docs, s, id_col, text_col), "components")
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    # rows that surely stay don't move with their texts
    marked = may_hold(docs, F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)), gone.select(F.xxhash64("__gone", "__hash")))
    met = (F.col(id_col) == F.col("__gone")) & (F.xxhash64(text_col) == F.col("__hash"))
    left = marked.where("not __may").union(marked.where("__may").join(gone, met, "left_anti")).drop("__may")
    twice = found.where(F.col("id") == F.col("component_id")).groupBy("id").count().where("count > 1").select(F.col("id").alias("__twice"))
    twice = keep(twice, "repeated")
    if twice.isEmpty():
        return left
    met = F.col(id_col) == F.col("__twice")  # what is left of such an id lies in one component
    return left.join(twice, met, "left_anti").union(left.join(twice, met, "left_semi").dropDuplicates([id_col]))
