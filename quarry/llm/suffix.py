"""Suffix-array deduplication of long repeated byte strings, within and across documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, bounded_batches, chunks, cut, mix, small, with_row_key

#: Bytes of text whose suffixes are sorted at once.
SHARD_BYTES = 1 << 20
_PIECE = 1 << 20
#: A group of equal regions with more than one in so many of all regions is handed out by broadcast.
HOT = 10_000
_BIG = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A region is packed into one number: start, size and the anchor's place in it, the last two in so many bits.
_BITS = 13
_CLASSES = 8


# --- suffix arrays ------------------------------------------------------------------------------------------------


def words8(data: np.ndarray) -> np.ndarray:
    """At every position, the next eight bytes as a big-endian number (zeros after the end)."""
    n = len(data)
    x = np.zeros(n + 8, dtype=np.uint64)
    x[:n] = data
    out = x[:n].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= x[k : n + k]
    return out


def suffix_array(
    data: np.ndarray, depth: int, w8: np.ndarray | None = None, offset: np.ndarray | None = None, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) by Larsson-Sadakane refinement: ranks by eight bytes first, then only the groups that are
    still tied are sorted by the rank of the suffix that many bytes on, doubling until ``depth`` bytes are compared (the
    last step is shorter, so that ranks tell exactly ``depth`` bytes). The end of the data sorts first.

    If only suffixes at an ``offset`` below ``wanted`` in their part of the data are to be in order, the last two rounds
    refine only those whose rank a wanted suffix still looks up."""
    n = len(data)
    w8 = words8(data) if w8 is None else w8
    sa = np.argsort(w8).astype(np.int32)  # half-size numbers, as most of the time goes to memory
    key = w8[sa]
    rank = np.zeros(n + depth, dtype=np.int32)  # zeros stand for what is past the end
    first = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, dtype=bool)
    # eight zero bytes at the end may be padding: the refinement below tells such suffixes apart by what follows
    group = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    rank[sa] = group + np.int32(1)
    h = 8
    tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]]))).astype(np.int32) if n else np.zeros(0, dtype=np.int32)
    while h < depth and len(tied):
        step = min(h, depth - h)
        at = sa[tied]
        if offset is not None and h + step + min(h + step, depth - h - step) >= depth:
            o, w = offset[at], wanted[at]
            used = o < w
            if h + step < depth:  # the last round looks this far on
                last = depth - h - step
                used |= (o >= last) & (o < w + last)
            tied, at = tied[used], at[used]
            if not len(tied):
                break
        both = rank[at].astype(np.int64) << np.int64(32) | rank[at + np.int32(step)]
        order = np.argsort(both)
        both, at = both[order], at[order]
        sa[tied] = at
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0)) + np.int32(1)
        last = np.concatenate([new[1:], [True]])
        tied = tied[~(new & last)]
        h += step
    return sa, rank[:n] - 1


def kasai(
    data: np.ndarray, sa: np.ndarray, rank: np.ndarray, cap: int, w8: np.ndarray | None = None,
    starts: np.ndarray | None = None, sizes: np.ndarray | None = None,
) -> np.ndarray:
    """Common prefix (at most cap bytes) of each suffix in the array with the one before it, by Kasai's rule: a suffix
    shares with its predecessor at least one byte less than the suffix that starts a byte earlier.

    Ranks tell exactly cap bytes. The array may hold only the suffixes of some runs of the text (starts, sizes); the
    runs advance together. The rule is not carried over where the predecessor's next suffix is not in the array, nor
    from suffixes of equal rank: these agree on cap bytes, and their order is open."""
    n = len(data)
    w8 = words8(data) if w8 is None else w8
    if starts is None:
        width = max(64, -(-n // 16_384))
        starts = np.arange(0, n, width)
        sizes = np.minimum(width, n - starts)
    before = np.full(n + 1, -2, dtype=np.int64)
    if len(sa):
        before[sa[0]] = -1
        before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, dtype=np.int64)
    i, end, h = starts.copy(), starts + sizes, np.zeros(len(starts), dtype=np.int64)
    while len(i):  # every lane compares eight bytes at a time, and moves on where they differ
        j = before[i]
        tie, none = (rank[i] == rank[j]) & (j >= 0), j < 0
        a, b = i + h, np.maximum(j, 0) + h
        room = n - np.maximum(a, b)
        x = w8[np.minimum(a, n - 1)] ^ w8[np.minimum(b, n - 1)]
        bits = np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1]  # of the highest bit set
        h += np.clip((64 - bits) >> 3, 0, room)
        np.minimum(h, cap, out=h)
        h[tie], h[none] = cap, 0
        over = np.flatnonzero(tie | none | (x != 0) | (h >= cap) | (room <= 8))
        lcp[i[over]] = h[over]
        loose = tie[over] | none[over] | (before[j[over] + 1] == -2)
        h[over] = np.where(loose, 0, np.maximum(h[over] - 1, 0))
        i[over] += 1
        if (i[over] == end[over]).any():
            on = np.flatnonzero(i < end)
            i, end, h = i[on], end[on], h[on]
    return lcp[sa]


def _compare(w8a: np.ndarray, i: np.ndarray, w8b: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Sign of a[i:i+length] against b[j:j+length]; both lie inside their arrays."""
    out = np.zeros(len(i), dtype=np.int8)
    todo = np.arange(len(i))
    for k in [*range(0, length - 7, 8), length - 8]:
        x, y = w8a[i[todo] + k], w8b[j[todo] + k]
        out[todo] = np.where(x < y, -1, np.where(x > y, 1, 0))
        todo = todo[x == y]
        if not len(todo):
            break
    return out


def merge_search(w8a: np.ndarray, starts: np.ndarray, w8b: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each string a[start:start+length], the index in the sorted starts ``order`` of b at which an equal string
    begins, or -1: binary search of one shard's strings in another shard's suffix array."""
    lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(order), dtype=np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            break
        mid = (lo[live] + hi[live]) // 2
        less = _compare(w8b, order[mid], w8a, starts[live], length) < 0
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    found = np.full(len(starts), -1, dtype=np.int64)
    inside = np.flatnonzero(lo < len(order))
    if len(inside):
        equal = _compare(w8b, order[lo[inside]], w8a, starts[inside], length) == 0
        found[inside[equal]] = lo[inside[equal]]
    return found


class Shard:
    """Regions of text with their sorted windows: runs of equal windows, and for each run the range of places in it."""

    def __init__(self, texts: list[bytes], place: np.ndarray, windows: list[int], often: np.ndarray, length: int):
        """place: a number for each region's first byte, such that equal places of the corpus have equal numbers."""
        self.length = length
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.w8 = words8(data)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(sizes) - sizes
        n_win = np.asarray(windows, dtype=np.int64)
        self.region = np.repeat(np.arange(len(texts)), n_win)
        self.offset = np.arange(len(self.region)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        at = begin[self.region] + self.offset
        is_start = np.full(len(data), -1, dtype=np.int64)
        is_start[at] = np.arange(len(at))
        span = np.arange(len(data)) - np.repeat(begin, sizes)
        sa, rank = suffix_array(data, length, self.w8, span, np.repeat(n_win, sizes))
        self.order = sa[is_start[sa] >= 0]  # of all suffixes, those that begin a window
        some = n_win > 0
        apart = kasai(data, self.order, rank, length, self.w8, begin[some], n_win[some])
        self.window = is_start[self.order]
        new = apart < length
        if len(new):
            new[0] = True
        self.run = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        places = (place[self.region] + self.offset)[self.window]
        self.low = np.minimum.reduceat(places, heads) if len(heads) else places
        self.high = np.maximum.reduceat(places, heads) if len(heads) else places
        many = often[self.region[self.window]]
        self.many = np.logical_or.reduceat(many, heads) if len(heads) else many
        self.heads = heads

    def repeated(self) -> np.ndarray:
        """For each window (by region, then offset): does its string start at another place too?"""
        out = np.zeros(len(self.region), dtype=bool)
        out[self.window] = ((self.low != self.high) | self.many)[self.run]
        return out

    def merge(self, other: Shard) -> None:
        """Tell both shards of the runs they share; one string for each run is searched."""
        if not len(self.heads) or not len(other.heads):
            return
        found = merge_search(self.w8, self.order[self.heads], other.w8, other.order, self.length)
        mine = np.flatnonzero(found >= 0)
        theirs = other.run[found[mine]]
        for x, ours in ((self.low, other.low), (self.high, other.high)):
            both = (np.minimum if x is self.low else np.maximum)(x[mine], ours[theirs])
            x[mine], ours[theirs] = both, both
        both = self.many[mine] | other.many[theirs]
        self.many[mine], other.many[theirs] = both, both


# --- candidate regions --------------------------------------------------------------------------------------------


def _anchors(batches: Iterator[pd.DataFrame], length: int, gram: int) -> Iterator[pd.DataFrame]:
    """For every window of ``length`` bytes, the first of its grams with the least hash is an anchor. Equal windows
    have equal anchors at equal offsets, so only regions around anchors whose gram occurs again can hold repeats."""
    span = length - gram + 1
    low = np.uint64((1 << 24) - 1)
    for df in batches:
        last = (-1, -1)
        raw = [t.encode() for t in df["_text"]]
        ids, ts = df["_id"].to_numpy(), df["_t"].to_numpy()
        keep = [i for i, t in enumerate(raw) if len(t) >= length]
        pieces = []  # (row, offset, bytes); pieces of a long text overlap by all but one byte of a window, and context
        for i in keep:
            t = raw[i]
            pieces += [(i, o, t[max(0, o - span) : o + _PIECE + length - 1 + length], min(o, span)) for o in range(0, len(t) - length + 1, _PIECE)]
        for a, b in chunks([len(p[2]) for p in pieces], _PIECE):
            data = np.frombuffer(b"".join(p[2] for p in pieces[a:b]), dtype=np.uint8)
            sizes = np.array([len(p[2]) for p in pieces[a:b]], dtype=np.int64)
            begin = np.cumsum(sizes) - sizes
            ph = PrefixHash(data)
            h = ph.grams(gram)
            v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            pad = -len(v) % span + span
            v = np.concatenate([v, np.full(pad, _BIG, dtype=np.uint64)]).reshape(-1, span)
            left = np.minimum.accumulate(v, axis=1).ravel()
            right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
            n_win = len(data) - length + 1
            best = np.minimum(right[:n_win], left[span - 1 : span - 1 + n_win])
            ok = np.zeros(n_win + length, dtype=bool)
            for s, n, p in zip(begin, sizes, pieces[a:b], strict=True):
                o, lead = p[1], p[3]
                total = len(raw[p[0]])
                ok[s + lead : s + min(n - length + 1, lead + min(_PIECE, total - length + 1 - o))] = True
            at = (best[ok[:n_win]] & low).astype(np.int64)
            if not len(at):
                continue
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            part = np.searchsorted(begin, at, "right") - 1
            row = np.array([p[0] for p in pieces[a:b]])[part]
            off = np.array([p[1] - p[3] for p in pieces[a:b]])[part]
            # neighbouring pieces of a long text can share an anchor
            real = at - begin[part] + off
            new = np.concatenate([[(row[0], real[0]) != last], (row[1:] != row[:-1]) | (real[1:] != real[:-1])])
            last = (row[-1], real[-1])
            at, part, row, off = at[new], part[new], row[new], off[new]
            if not len(at):
                continue
            s = np.maximum(begin[part], at - (span - 1))
            e = np.minimum(begin[part] + sizes[part], at + length)
            key = h[at]
            shape = mix(((at - s) * 65536 + (e - at)).astype(np.uint64))
            loc = (s - begin[part] + off) << 2 * _BITS | (e - s) << _BITS | (at - s)
            yield pd.DataFrame(
                {
                    "_id": ids[row], "_t": ts[row], "key": key.view(np.int64), "same": (ph.of(s, e) ^ shape).view(np.int64), "loc": loc,
                }
            )


_REGION = ["_id", "_t", "key", "salt", "start", "lead", "often", "bytes"]


def _cut_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    mask = (1 << _BITS) - 1
    for df in batches:
        out = []
        for i, t, text, regions in zip(df["_id"], df["_t"], df["_text"], df["regions"], strict=True):
            raw = text.encode() if text is not None else b""
            for r in regions if regions is not None else ():
                start, size = r["loc"] >> 2 * _BITS, r["loc"] >> _BITS & mask
                out.append((i, t, r["key"], r["salt"], start, r["loc"] & mask, r["often"], raw[start : start + size]))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=_REGION)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_REGION)


def _prune(df: pd.DataFrame, length: int, span: int) -> pd.DataFrame:
    """Regions of whole keys, narrowed to where a repeat is possible. The windows of a region fall into classes by
    their distance to the anchor; all windows of a class share a core of bytes, so a class whose core occurs once under
    its key holds no repeat."""
    size = df["bytes"].str.len().to_numpy()
    begin = np.cumsum(size) - size
    lead, key = df["lead"].to_numpy().astype(np.int64), df["key"].to_numpy()
    ph = PrefixHash(np.frombuffer(b"".join(df["bytes"]), dtype=np.uint8))
    bounds = np.linspace(0, span, _CLASSES + 1).astype(np.int64)  # windows at distance bounds[j] to bounds[j + 1] - 1
    first, last = np.full(len(df), 1 << 40), np.full(len(df), -1)
    for lo, hi in zip(bounds[:-1], bounds[1:] - 1, strict=True):
        # window starts in the region, from the farthest to the nearest of the class
        a, b = np.maximum(lead - hi, 0), np.minimum(lead - lo, size - length)
        ok = np.flatnonzero(a <= b)
        core = ph.of(begin[ok] + lead[ok] - lo, begin[ok] + lead[ok] - hi + length)
        # one number for key and core: should two fall together, a class is sorted for nothing
        _, inv, n = np.unique(core + mix(key[ok].view(np.uint64)), return_inverse=True, return_counts=True)
        twice = ok[n[inv] > 1]
        first[twice] = np.minimum(first[twice], a[twice])
        last[twice] = np.maximum(last[twice], b[twice])
    keep = np.flatnonzero(last >= 0)
    out = df.iloc[keep].copy()
    out["bytes"] = [x[f : e + length] for x, f, e in zip(out["bytes"], first[keep], last[keep], strict=True)]
    out["start"] += first[keep]
    return out.reset_index(drop=True)


def _spans(out: list, ids, ts, starts, windows, repeated: np.ndarray, length: int) -> None:
    """Runs of repeated windows of each region, as covered byte ranges of its document."""
    at = 0
    for i, t, s, n in zip(ids, ts, starts, windows, strict=True):
        r = repeated[at : at + n]
        at += n
        if r.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], r.view(np.int8), [0]])))
            out += [(i, t, int(s + a), int(s + b - 1 + length)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _key_shards(df: pd.DataFrame, length: int, shard_bytes: int) -> pd.DataFrame:
    """Spans that repeat among the regions of whole keys: shards of bounded size; shards that continue a key are merged
    by binary search, others share no window."""
    docs: dict[tuple[int, int], int] = {}
    chain: list[tuple[pd.DataFrame, Shard, list[int]]] = []
    rows: list = []

    def close() -> None:
        for x, shard, windows in chain:
            _spans(rows, x["_id"], x["_t"], x["start"], windows, shard.repeated(), length)
        chain.clear()

    # whole keys together up to the size of a shard; a larger key in shards of its own
    size = df["bytes"].str.len().to_numpy()
    key = df["key"].to_numpy()
    edge = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(df)]])
    upto = np.concatenate([[0], np.cumsum(size)])
    for i, j in chunks(upto[edge[1:]] - upto[edge[:-1]], shard_bytes):
        a, b = edge[i], edge[j]
        for p, q in chunks(size[a:b], max(shard_bytes, int(upto[b] - upto[a]) if j - i > 1 else 0)):
            x = df.iloc[a + p : a + q]
            place = np.array([docs.setdefault(k, len(docs)) for k in zip(x["_id"], x["_t"], strict=True)], dtype=np.int64)
            windows = [len(t) - length + 1 for t in x["bytes"]]
            shard = Shard(x["bytes"].tolist(), (place << np.int64(36)) + x["start"].to_numpy(), windows, x["often"].to_numpy(dtype=bool), length)
            for _, other, _ in chain:
                shard.merge(other)
            chain.append((x, shard, windows))
        close()
    return pd.DataFrame(rows, columns=["_id", "_t", "s", "e"])


#: A window that no other window of its shard equals, or one of several that do (``many``).
_PRINT = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("at", "<i8"), ("t", "<i4"), ("many", "<i4")])


_FOUND = ["_id", "_t", "s", "e", "r", "prints"]


def _prints(df: pd.DataFrame, length: int, ranges: int) -> Iterator[pd.DataFrame]:
    """One shard of a very common key: the spans that repeat inside it, and for the merge across shards one print of
    every different window, sorted and cut into ranges of the hash."""
    ids, ts, starts = df["_id"].to_numpy(), df["_t"].to_numpy(), df["start"].to_numpy()
    docs: dict[tuple[int, int], int] = {}
    place = np.array([docs.setdefault(k, len(docs)) for k in zip(ids, ts, strict=True)], dtype=np.int64)
    windows = [len(b) - length + 1 for b in df["bytes"]]
    shard = Shard(df["bytes"].tolist(), (place << np.int64(36)) + starts, windows, df["often"].to_numpy(dtype=bool), length)
    spans: list = []
    _spans(spans, ids, ts, starts, windows, shard.repeated(), length)
    if spans:
        yield pd.DataFrame(spans, columns=_FOUND[:4]).assign(r=-1, prints=b"")
    data = np.frombuffer(b"".join(df["bytes"]), dtype=np.uint8)
    first = shard.order[shard.heads]
    who, offset = shard.region[shard.window[shard.heads]], shard.offset[shard.window[shard.heads]]
    out = np.empty(len(first), dtype=_PRINT)
    out["h1"] = PrefixHash(data).grams(length)[first]
    out["h2"] = PrefixHash(data[::-1].copy()).grams(length)[len(data) - length - first]
    out["id"], out["t"], out["at"] = ids[who], ts[who], starts[who] + offset
    out["many"] = (shard.low != shard.high) | shard.many
    out.sort(order=["h1", "h2"])
    edges = np.searchsorted(out["h1"], (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64))
    blobs = [(r, x.tobytes()) for r, x in enumerate(np.split(out, edges)) if len(x)]
    if blobs:
        yield pd.DataFrame(blobs, columns=_FOUND[4:]).assign(_id=0, _t=0, s=0, e=0)[_FOUND]


def _shards(length: int, span: int, shard_bytes: int, ranges: int):
    """Suffix arrays over one partition's regions, which come in order of key and salt (-1: the key is not salted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def give(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if df["salt"].iloc[0] >= 0:
                yield from _prints(df, length, ranges)
                return
            df = _prune(df, length, span)
            if len(df):
                yield _key_shards(df, length, shard_bytes).assign(r=-1, prints=b"")

        for df in batches:
            mark = df["key"].to_numpy() ^ df["salt"].to_numpy()
            salted = df["salt"].to_numpy() >= 0
            sizes = df["bytes"].str.len().to_numpy()
            new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (salted[1:] != salted[:-1])])
            edge = np.concatenate([np.flatnonzero(new), [len(df)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = df.iloc[a:b]
                now, was = part.iloc[0], held[-1].iloc[-1] if held else None
                other = held and (now["key"], now["salt"]) != (was["key"], was["salt"])
                if other and (now["salt"] >= 0 or was["salt"] >= 0 or size > 2 * shard_bytes):
                    yield from give(pd.concat(held, ignore_index=True))
                    held, size = [], 0
                held.append(part)
                size += int(sizes[a:b].sum())
        if held:
            yield from give(pd.concat(held, ignore_index=True))

    return run


def _merge_prints(length: int):
    """One range of the hash at a time: the sorted runs of all shards are merged by binary search; what is found in two
    places, or was found several times in a shard, is repeated."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(b, dtype=_PRINT) for b in df["prints"]]
        while len(runs) > 1:  # pairwise: each element of the shorter run is placed in the longer one
            runs.sort(key=len)
            a, b = runs[0], runs[1]
            runs = [*runs[2:], np.insert(b, np.searchsorted(b["h1"], a["h1"], "right"), a)]
        x = runs[0]
        # ties of h1 are put in order of h2
        order = np.lexsort((x["h2"], x["h1"])) if (x["h1"][1:] == x["h1"][:-1]).any() else np.arange(len(x))
        x = x[order]
        new = np.concatenate([[True], (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])])
        heads = np.flatnonzero(new)
        first = x[heads[np.cumsum(new) - 1]]
        other = (x["id"] != first["id"]) | (x["t"] != first["t"]) | (x["at"] != first["at"]) | (x["many"] != 0)
        hit = np.logical_or.reduceat(other, heads)[np.cumsum(new) - 1]
        y = x[hit]
        return pd.DataFrame({"_id": y["id"], "_t": y["t"], "s": y["at"], "e": y["at"] + length})

    return run


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for text, spans in zip(df["_text"], df["spans"], strict=True):
            raw, kept, n_spans, at, removed = text.encode(), [], 0, 0, 0
            end = -1
            for x in sorted((x["s"], x["e"]) for x in spans) if spans is not None else ():
                if x[0] > end:
                    n_spans += 1
                    kept.append(raw[at : x[0]])
                    removed += x[1] - x[0]
                    end = at = x[1]
                elif x[1] > end:
                    removed += x[1] - end
                    end = at = x[1]
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((removed, n_spans, left, hashlib.sha256(left).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_bytes", "kept_sha256"])
        yield pd.concat([df[["_row"]].reset_index(drop=True), out], axis=1)


def _by_group(rows: DataFrame, groups: DataFrame, on: list[str], size: Column) -> DataFrame:
    """rows joined to their groups. Groups with over a HOT-th of the rows that all groups have, of which there are fewer
    than HOT, are broadcast, so that none of their rows is shuffled."""
    every = groups.agg(F.sum(size)).first()[0] or 0
    hot = size * HOT > F.lit(every)
    few = F.broadcast(groups.filter(hot))
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(groups.filter(~hot), on))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 128,
    shard_bytes: int = SHARD_BYTES, common: int = 4_000,
) -> DataFrame:
    """(_id, _t, s, e): byte ranges of the texts that are covered by ``length``-byte strings that start elsewhere too.

    1. Anchors: each window's least-hashed gram. Regions around anchors whose gram occurs once hold no repeat.
    2. Equal regions (of equal gram, shape and content by two 64-bit hashes) are counted, so that a hot group of copies
       is pre-aggregated; they are repeated as a whole, and one of them stands for all.
    3. Regions that differ but share their gram go, ordered by gram, into shards whose suffix arrays (Larsson-Sadakane)
       and common prefixes (Kasai) tell which windows repeat; shards of one gram are merged by binary search.
    4. A gram with more than ``common`` different regions would fill one task: its regions are salted over several
       shards, and the sorted prints of their windows are merged across the shards by range, each range in a task.
    """
    bounded_batches(docs.sparkSession)
    base = with_row_key(docs, id_col, text_col, id_col)  # the same columns as in suffix_dedup, so that one shuffle serves both
    anchors = cut(base.mapInPandas(lambda b: _anchors(b, length, gram), "_id long, _t int, key long, same long, loc long"), "anchors")
    alike = anchors.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_t", "loc")).alias("at"))
    keys = alike.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).filter("all > 1")
    alike = cut(alike.join(keys, "key"), "alike")
    copies = _by_group(anchors, alike.filter("n > 1").select("key", "same", "n"), ["key", "same"], F.col("n"))
    size = F.shiftright("loc", _BITS).bitwiseAND((1 << _BITS) - 1)
    start = F.shiftright("loc", 2 * _BITS)
    whole = copies.select("_id", "_t", start.alias("s"), (start + size).alias("e"))
    salt = F.when(F.col("kinds") > common, F.pmod(F.xxhash64("at"), F.ceil(F.col("kinds") / F.lit(common))).cast("int")).otherwise(F.lit(-1))
    differ = alike.filter("kinds > 1").select("at.*", "key", (F.col("n") > 1).alias("often"), salt.alias("salt"))
    wanted = differ.groupBy("_id", "_t").agg(F.collect_list(F.struct("key", "salt", "loc", "often")).alias("regions"))
    regions = base.join(wanted, ["_id", "_t"], "left").select("_id", "_t", F.when(F.col("regions").isNotNull(), F.col("_text")).alias("_text"), "regions")
    regions = regions.mapInPandas(_cut_regions, "_id long, _t int, key long, salt int, start long, lead int, often boolean, bytes binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    regions = regions.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "_id", "_t", "start")
    kinds = alike.filter(F.col("kinds") > common).groupBy("key").agg(F.first("kinds").alias("k")).agg(F.sum("k")).first()[0]
    ranges = max(1, (kinds or 0) // 1000)
    found = regions.mapInPandas(_shards(length, length - gram + 1, shard_bytes, ranges), "_id long, _t int, s long, e long, r int, prints binary")
    if not kinds:
        return whole.unionByName(found.select("_id", "_t", "s", "e"))
    # both readers take all columns of one exchange, so that the shards are sorted once
    found = found.repartition(parts, "r", "_id")
    none = F.array().cast("array<struct<_id:bigint,_t:int,s:bigint,e:bigint,x:int>>")
    local = found.select(F.explode(F.when(F.col("r") < 0, F.array(F.struct("_id", "_t", "s", "e", F.octet_length("prints").alias("x")))).otherwise(none)).alias("y"))
    across = _ranges(found).groupBy("r").applyInPandas(_merge_prints(length), "_id long, _t int, s long, e long")
    return whole.unionByName(local.select("y._id", "y._t", "y.s", "y.e")).unionByName(across)


def _ranges(found: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<_id:bigint,_t:int,s:bigint,e:bigint,r:int,prints:binary>>")
    return found.select(F.explode(F.when(F.col("r") >= 0, F.array(F.struct("_id", "_t", "s", "e", "r", "prints"))).otherwise(none)).alias("y")).select("y.*")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, **options) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_bytes (what is left, not always valid UTF-8),
    kept_sha256.

    Each byte covered by a ``length``-byte string that also starts at another place (same document or not; overlaps
    count) is removed, as judged on the input. Matches never cross documents. Null and empty texts have no bytes;
    rows that repeat an id and a text are two places and lose everything that is long enough; a text of any length is
    read whole, in overlapping pieces; an empty table gives no rows; extra columns are ignored, whatever their names.
    """
    found = repeated_spans(docs, id_col, text_col, length, **options)
    spans = found.groupBy("_id", "_t").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    rows = with_row_key(docs, id_col, text_col, id_col).join(spans, ["_id", "_t"], "left")
    rows = rows.select(F.col(id_col).alias("_row"), "_text", "spans")
    return rows.mapInPandas(_finish, f"_row {docs.schema[id_col].dataType.simpleString()}, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string").select(
        F.col("_row").alias(id_col),
        (F.col("n_removed") + F.octet_length("kept_bytes")).cast("long").alias("n_bytes"),
        "n_removed", "n_spans", "kept_bytes", "kept_sha256",
    )
