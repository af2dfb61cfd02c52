"""Similarity joins without loss: Hamming distance on hashes, Jaccard on bigrams, video frames."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.vectors import hamming
from gritstone.operators import setjoin
from gritstone.operators.graph import connected_components
from gritstone.session import cut, scratch_path


#: Share of all pairs that a band join may bring together; beyond it blocks of all pairs cost less.
SELECTIVE = 0.05


def bands_of(words: int, most: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of most // 2 + 1 bands: hashes at most ``most`` bits apart differ in one bit at most on one of them."""
    count = most // 2 + 1
    out = []
    for w in range(words):
        own = count * (w + 1) // words - count * w // words
        edges = [64 * i // own for i in range(own + 1)] if own else []
        out += [(w, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def meeting_share(words: int, most: int) -> float:
    """The share of pairs of random hashes that band_links brings together, once or oftener."""
    return sum((width + 1) / 2.0**width for _, _, width in bands_of(words, most))


def hamming_links(rows: DataFrame, most: int, key: str = "id", columns: tuple[str, ...] = ("hash",)) -> DataFrame:
    """(src, dst, distance) of different hashes at most ``most`` bits apart, src and dst being the smallest ids of their hash.

    A hash is one 64-bit word or several.  Equal hashes collapse first: a group
    of copies is one row here (see hash_classes).  Where bands are selective (19
    of 192 bits: 0.1 % of all pairs) an equi-join on bands finds every pair; a
    wide radius (18 of 64 bits) leaves bands of a few bits that meet nearly
    always, so all pairs are weighed in blocks, which is quadratic.  The choice
    depends on the number of bits alone.
    """
    have = F.lit(True)
    for c in columns:
        have = have & F.col(c).isNotNull()
    names = [f"h{i}" for i in range(len(columns))]
    reps = rows.where(have).groupBy(*[F.col(c).cast("long").alias(n) for c, n in zip(columns, names, strict=True)]).agg(F.min(key).alias("id"))
    return band_links(reps, names, most) if meeting_share(len(columns), most) <= SELECTIVE else block_links(reps, names, most)


def _distance(names: list[str], a: str, b: str) -> Column:
    return sum((hamming(f"{a}.{n}", f"{b}.{n}") for n in names[1:]), hamming(f"{a}.{names[0]}", f"{b}.{names[0]}"))


def band_links(reps: DataFrame, names: list[str], most: int, others: DataFrame | None = None, also: Column | None = None) -> DataFrame:
    """(src, dst, distance) of rows(id, *names), or of these with others, that also holds for, as sides a and b; other columns go along.

    One side brings each band as it is, the other each band as it is and with
    every bit turned, so rows grow with the number of bits and pairs are found
    that differ in one bit of a band at most.
    """
    bands = bands_of(len(names), most)
    value = lambda w, a, n: F.shiftrightunsigned(names[w], a).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))
    exact = F.array(*[F.struct(F.lit(i).alias("n"), value(*b).alias("v")) for i, b in enumerate(bands)])

    def turned(i: int, band: tuple[int, int, int]) -> Column:
        flips = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(band[2])])
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("n"), value(*band).bitwiseXOR(x).alias("v")))

    one = reps.select("*", F.explode(exact).alias("band")).alias("a")
    two = (reps if others is None else others).select("*", F.explode(F.concat(exact, *[turned(i, b) for i, b in enumerate(bands)])).alias("band")).alias("b")
    far = _distance(names, "a", "b")
    # Bands meet both ways round, so within one table a pair is taken one way.
    met = (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id") if others is None else F.col("a.id") != F.col("b.id")) & (far <= most)
    pairs = one.join(two, met if also is None else met & also)
    return pairs.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"), far.alias("distance")).distinct()


def block_links(reps: DataFrame, names: list[str], most: int, block_rows: int = 8_192) -> DataFrame:
    """(src, dst, distance) of all pairs of rows(id, *names): each pair of blocks is one task, so a row is sent once for each block."""
    blocks = max(1, -(-reps.count() // block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = reps.select("id", *names, own.alias("own")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "k").alias("a"), F.greatest("own", "k").alias("b"), "own", "id", *names)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        one, two = pdf[pdf["own"] == a], pdf[pdf["own"] == b]
        ids, others = one["id"].to_numpy(), two["id"].to_numpy()
        out = []
        for at in range(0, len(one), 256):
            far = np.zeros((len(ids[at : at + 256]), len(others)), np.int16)
            for n in names:
                far += np.bitwise_count(one[n].to_numpy()[at : at + 256, None].view(np.uint64) ^ two[n].to_numpy()[None, :].view(np.uint64))
            i, j = np.nonzero(far <= most)
            x, y = ids[at : at + 256][i], others[j]
            keep = x < y if a == b else x != y
            out.append(pd.DataFrame({"src": np.minimum(x, y)[keep], "dst": np.maximum(x, y)[keep], "distance": far[i, j][keep].astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "distance": []})

    kind = dict(reps.dtypes)["id"]
    return dealt.groupBy("a", "b").applyInPandas(meet, f"src {kind}, dst {kind}, distance int")


def hash_members(rows: DataFrame, key: str = "id", columns: tuple[str, ...] = ("hash",)) -> DataFrame:
    """(id, rep) of all rows with any hash; rep is the smallest id of the rows that have the same hashes, and miss the same.

    The smallest id is a combined aggregate, and the join back to the rows is one
    that adaptive execution splits where a hash is hot.
    """
    names = [f"h{i}" for i in range(len(columns))]
    have = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    each = rows.where(have).select(F.col(key).alias("id"), *[F.col(c).cast("long").alias(n) for c, n in zip(columns, names, strict=True)])
    reps = each.groupBy(*names).agg(F.min("id").alias("rep")).select("rep", *[F.col(n).alias(f"r{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"r{n}"))
    return each.join(reps, same).select("id", "rep")


def class_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, class_size, n_links, component) of all members(id, rep), from links(src, dst) between representatives.

    n_links counts rows, copies included: the others of the class, and all of each
    linked class.  Nothing is expanded into pairs.  Links are worked out once, for
    the counts and for the components.
    """
    links = cut(links.select("src", "dst"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("class_size"))
    both = links.select(F.col("src").alias("rep"), F.col("dst").alias("other")).unionByName(links.select(F.col("dst").alias("rep"), F.col("src").alias("other")))
    beyond = both.join(sizes.select(F.col("rep").alias("other"), "class_size"), "other").groupBy("rep").agg(F.sum("class_size").alias("beyond"))
    return _class_rows(members, beyond, connected_components(links))


def _class_rows(members: DataFrame, beyond: DataFrame, components: DataFrame) -> DataFrame:
    """class_rows from beyond(rep, beyond), the rows of all linked classes, and components(node, component)."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("class_size"))
    classes = sizes.join(beyond, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("rep", "class_size", (F.col("class_size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return members.join(classes, "rep").select("id", F.col("rep").alias("class_id"), "class_size", "n_links", "component")


def with_members(links: DataFrame, members: DataFrame, value: str, same: Column) -> DataFrame:
    """links between representatives, and from each representative to the other rows of its class, with the value ``same``."""
    own = members.where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"), same.alias(value))
    return links.select("src", "dst", value).unionByName(own)


def composite_links(rows: DataFrame, threshold: float = 0.90, key: str = "id", kinds: tuple[str, ...] = ("p", "d", "a")) -> DataFrame:
    """(src, dst, similarity) of rows with different hashes, alike by composite_similarity from threshold on.

    src and dst stand for all rows with the same hashes that miss the same kinds.
    Two rows are compared on the kinds that both have, so there is a join for
    each set of kinds, of those masks (kinds that a row has) that share just
    these: the pair of masks is part of the join's key, and the mask with fewer
    rows brings the turned bits.  The mean of the kinds' similarities is one less
    the differing bits over all bits of the set.
    """
    have = F.coalesce(*[F.col(k) for k in kinds]).isNotNull()
    mask = sum((F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(kinds)), F.lit(0))
    reps = rows.where(have).withColumn("_m", mask).groupBy("_m", *kinds).agg(F.min(key).alias("id"))
    reps = cut(reps.select("id", F.col("_m").alias("mask"), *[F.col(k).cast("long").alias(f"h{i}") for i, k in enumerate(kinds)]))
    held = {r["mask"]: r["count"] for r in reps.groupBy("mask").count().collect()}
    out = None
    for common in range(1, 1 << len(kinds)):
        names = [f"h{i}" for i in range(len(kinds)) if common >> i & 1]
        bits = 64 * len(names)
        pairs = [(x, y) if held.get(x, 0) >= held.get(y, 0) else (y, x) for x in range(1 << len(kinds)) for y in range(x + 1) if x & y == common]

        def side(n: int, pairs=pairs, names=names) -> DataFrame:
            """Rows as side n of the pairs of masks, once for each."""
            of = {m: [i for i, p in enumerate(pairs) if p[n] == m] for m in {p[n] for p in pairs}}
            codes = F.create_map(*[F.lit(x) if i % 2 == 0 else F.array(*[F.lit(c) for c in x]) for m in sorted(of) for i, x in enumerate((m, of[m]))])
            return reps.where(F.col("mask").isin(sorted(of))).select("id", "mask", *names, F.explode(codes[F.col("mask")]).alias("pair"))

        only = (F.col("a.pair") == F.col("b.pair")) & ((F.col("a.mask") != F.col("b.mask")) | (F.col("a.id") < F.col("b.id")))
        found = band_links(side(0), names, bound(threshold, bits), side(1), only).select("src", "dst", F.round(1 - F.col("distance") / float(bits), 9).alias("similarity"))
        out = found if out is None else out.unionByName(found)
    return out


def hash_classes(rows: DataFrame, links: DataFrame, key: str = "id", column: str = "hash") -> DataFrame:
    """(id, component): copies share their hash's smallest id, linked hashes the smallest of their component."""
    rep = hash_members(rows, key, (column,)).withColumnRenamed("rep", "_r")
    comp = connected_components(links)
    return rep.join(comp.withColumnRenamed("node", "_r"), "_r", "left").select("id", F.coalesce("component", "_r").alias("component"))


def composite_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean of 1 - distance / 64 over the hash kinds both sides have; 0 without one."""
    each = [F.when(a[k].isNotNull() & b[k].isNotNull(), 1 - hamming(a[k], b[k]) / 64.0) for k in a if k in b]
    n = sum((x.isNotNull().cast("int") for x in each), F.lit(0))
    return F.coalesce(F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in each), F.lit(0.0)), n.cast("double")), F.lit(0.0))


def hash_text(p: Column, d: Column, a: Column) -> Column:
    """p:<hex>|d:<hex>|a:<hex>, leaving out what is missing."""
    part = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(k + ":"), F.lower(F.lpad(F.hex(c), 16, "0"))))
    return F.concat_ws("|", part("p", p), part("d", d), part("a", a))


def parse_hash(text: Column, kind: str) -> Column:
    """The 16 hex digits of one kind, null without it."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|\|){kind}:([0-9a-fA-F]{{16}})", 1), F.lit(""))


def normalised(text: str | Column, cap: int | None = None) -> Column:
    """Lower case, white space collapsed; with cap, the first characters only."""
    t = F.trim(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"(?U)\s+", " "))
    return t if cap is None else F.substring(t, 1, cap)


def character_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a text of one character is its own."""
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.when(F.char_length(text) <= 1, F.filter(chars, lambda x: x != "")).otherwise(F.filter(pairs, lambda x: x.isNotNull())))


def jaccard_links(sets: DataFrame, threshold: float, key: str = "id", column: str = "grams") -> DataFrame:
    """(src, dst, sim) of different sets whose Jaccard reaches threshold, src and dst standing for all rows of their set.

    Equal sets collapse first; the others meet in blocks (see setjoin).
    """
    return setjoin.links(setjoin.numbered(set_classes(sets, key, column)[1]), threshold)


def set_classes(sets: DataFrame, key: str = "id", column: str = "grams") -> tuple[DataFrame, DataFrame]:
    """(id, rep) of all rows with a set that is not empty, and (id, g, size): the set of each representative, the smallest id of equal sets, and their number."""
    each = sets.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(column)).alias("g")).where(F.size("g") > 0)
    digest = F.unhex(F.sha2(F.array_join(F.col("g").cast("array<string>"), "\x1f"), 256))
    return _classes(each.select("id", digest.alias("digest"), "g"))


def _classes(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """set_classes of rows(id, digest, g), which are worked out once and kept as compressed Parquet in the shared folder."""
    path = scratch_path(each.sparkSession, "sets")
    each.write.parquet(path)
    each = each.sparkSession.read.parquet(path)
    named = each.select("id", "digest")
    reps = cut(named.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    members = cut(named.join(reps.select("digest", "rep").hint("merge"), "digest").select("id", "rep"))
    # An id that repeats may stand for several sets; the one with the smallest digest is taken.
    first = reps.where("rep is not null").groupBy(F.col("rep").alias("id")).agg(F.min("digest").alias("digest"), F.sum("size").alias("size"))
    # Dealt out as the join needs it, so rows that repeat fall together without another shuffle.
    return members, each.join(first.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"]).select("id", "g", "size")


def document_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50) -> tuple[DataFrame, DataFrame]:
    """set_classes of the bigrams of all texts longer than ``least`` characters; whole normalised texts count."""
    long = docs.where(F.char_length(text) > least).select(F.col(key).alias("id"), F.lower(text).alias("body"))
    return _classes(long.select("id", _bigram_codes()("body").alias("x")).select("id", "x.digest", "x.g").where("digest is not null"))


def document_links(docs: DataFrame, threshold: float = 0.95, key: str = "doc_id", text: str = "text", least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of all texts longer than ``least`` characters, texts with equal sets of bigrams being one class, and the links of their representatives."""
    members, sets = document_sets(docs, key, text, least)
    return members, setjoin.links(sets, threshold)


def document_classes(docs: DataFrame, threshold: float = 0.95, key: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """class_rows of document_links without a row for each link, as they may be as many as the square of the texts."""
    members, sets = document_sets(docs, key, text, least)
    found = cut(setjoin.sums(sets, threshold))
    beyond = found.groupBy(F.col("id").alias("rep")).agg(F.sum("beyond").alias("beyond"))
    return _class_rows(members, beyond, connected_components(found, "id", "root"))


#: What (?U)\s is: White_Space; and a byte of Latin-1 as itself, or a blank.
_SPACES = np.zeros(0x110000, bool)
_SPACES[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BLANKED = np.where(_SPACES[:256], 32, np.arange(256)).astype(np.uint8).tobytes()


def _collapsed(text: str) -> bytes | np.ndarray:
    """A text with a blank for white space of any length, and none at the ends: as Latin-1, or else as code points."""
    try:
        out = text.encode("latin-1").translate(_BLANKED)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        spaces = _SPACES[points]
        kept = ~spaces
        # The first of each run stays, but not one at the start.
        kept[1:] |= ~spaces[:-1]
        points = np.where(spaces, np.uint32(32), points)[kept]
        return points[int(len(points) > 0 and points[0] == 32) : len(points) - int(len(points) > 1 and points[-1] == 32)]
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out.strip(b" ")


def _bigrams(texts: list[str]) -> list[np.ndarray]:
    """Distinct pairs of neighbouring characters of each text, as ascending numbers; a text of one character is its own."""
    texts = [_collapsed(t) for t in texts]
    alphabet = np.flatnonzero(np.bincount(np.frombuffer(b"".join([t for t in texts if isinstance(t, bytes)]), np.uint8), minlength=256))
    code = np.zeros(256, np.uint8)
    code[alphabet] = np.arange(len(alphabet))
    pairs, seen, out = (alphabet[:, None] << 21 | alphabet).ravel(), np.zeros(len(alphabet) ** 2, bool), []
    for text in texts:
        if len(text) < 2:
            out.append(-1 - np.array([*text], np.int64))
        elif isinstance(text, bytes):
            points = np.frombuffer(text.translate(code.tobytes()), np.uint8).astype(np.intp)
            seen[points[:-1] * len(alphabet) + points[1:]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            out.append(pairs[found])
        else:
            points = text.astype(np.int64)
            out.append(np.unique(points[:-1] << 21 | points[1:]))
    return out


def _bigram_codes():
    """_bigrams with white space collapsed, and their digest; an empty text has none."""
    @F.pandas_udf("digest binary, g array<long>")
    def codes(texts: pd.Series) -> pd.DataFrame:
        out = [g for at in range(0, len(texts), 256) for g in _bigrams(texts.iloc[at : at + 256].tolist())]
        return pd.DataFrame({"digest": pd.Series([hashlib.sha256(g.tobytes()).digest() if len(g) else None for g in out], dtype=object), "g": pd.Series(out, dtype=object)})

    # A deterministic one would be worked out once more for every condition on its result.
    return codes.asNondeterministic()


def video_similarity(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim): the mean, over the frames of the video with fewer (ties: a), of the best match in the other.

    frames (video, frame, p, d) with 64-bit hashes; a match is the mean of both hashes' similarities.
    """
    counts = frames.groupBy("video").agg(F.count("*").alias("n"))
    sided = pairs.join(counts.select(F.col("video").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("video").alias("b"), F.col("n").alias("nb")), "b")
    sided = sided.select("a", "b", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("other"))
    left = sided.join(frames.select(F.col("video").alias("lead"), F.col("frame").alias("f"), F.col("p").alias("p1"), F.col("d").alias("d1")), "lead")
    both = left.join(frames.select(F.col("video").alias("other"), F.col("p").alias("p2"), F.col("d").alias("d2")), "other")
    match = ((1 - hamming("p1", "p2") / 64.0) + (1 - hamming("d1", "d2") / 64.0)) / 2
    best = both.groupBy("a", "b", "f").agg(F.max(match).alias("m"))
    return best.groupBy("a", "b").agg(F.round(F.avg("m"), 9).alias("sim"))


def video_links(frames: DataFrame, threshold: float = 0.70, block_rows: int = 2_048) -> DataFrame:
    """(src, dst, sim) with src < dst of all videos that are alike by video_similarity from ``threshold`` on, exactly.

    Videos are dealt into b blocks; a pair of blocks meets in one task, as
    neighbour_pairs does it.  At 0.70 a pair of frames may differ in 38 of 128
    bits, so bands that lose no pair are three bits wide and would meet more
    often than all pairs do.  Frames without both hashes are left out.
    """
    frames = frames.where("video is not null and p is not null and d is not null")
    blocks = max(1, -(-frames.count() // block_rows))
    part = F.pmod(F.xxhash64("video"), F.lit(blocks)).cast("int")
    dealt = frames.select(F.col("video").cast("long").alias("video"), F.col("p").cast("long").alias("p"), F.col("d").cast("long").alias("d"), part.alias("own"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "k").alias("a"), F.greatest("own", "k").alias("b"), "own", "video", "p", "d")

    def side(pdf: pd.DataFrame, block: int):
        rows = pdf[pdf["own"] == block].sort_values("video", kind="stable")
        video, starts = np.unique(rows["video"].to_numpy(), return_index=True)
        return video, starts, np.diff(np.append(starts, len(rows))), rows["p"].to_numpy().view(np.uint64), rows["d"].to_numpy().view(np.uint64)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        one, two = side(pdf, a), side(pdf, b)
        out = []
        if len(one[0]) and len(two[0]):
            video, starts, counts, p, d = two
            at, ends = 0, np.append(one[1], len(one[3]))
            while at < len(one[0]):
                # Whole videos, some 256 frames at a time (a longer video alone).
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + 256, side="right")) - 1)
                rows = slice(ends[at], ends[upto])
                far = np.bitwise_count(one[3][rows, None] ^ p[None, :]).astype(np.int16)
                far += np.bitwise_count(one[4][rows, None] ^ d[None, :])
                first = one[1][at:upto] - ends[at]
                n = one[2][at:upto, None]
                forth = np.add.reduceat(np.minimum.reduceat(far, starts, axis=1).astype(np.int64), first, axis=0) / n
                back = np.add.reduceat(np.minimum.reduceat(far, first, axis=0).astype(np.int64), starts, axis=1) / counts[None, :]
                left, right = one[0][at:upto, None], video[None, :]
                leads = (n < counts[None, :]) | ((n == counts[None, :]) & (left < right))
                sim = np.round(1 - np.where(leads, forth, back) / 128.0, 9)
                i, j = np.nonzero((sim >= threshold) & ((left < right) if a == b else (left != right)))
                x, y = one[0][at:upto][i], video[j]
                out.append(pd.DataFrame({"src": np.minimum(x, y), "dst": np.maximum(x, y), "sim": sim[i, j]}))
                at = upto
        return pd.concat(out) if out else pd.DataFrame({"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64), "sim": np.empty(0)})

    return dealt.groupBy("a", "b").applyInPandas(meet, "src long, dst long, sim double")


def bound(threshold: float, bits: int) -> int:
    """Bits that may differ at a similarity of at least threshold."""
    return math.floor((1 - threshold) * bits + 1e-9)
