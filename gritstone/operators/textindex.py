"""A stored positional index of texts, and searches in it as users type them.

Postings lie in buckets by the first two letters of their token, sorted by token,
so a search reads the buckets of its words and in them the row groups of its
tokens.  A posting row holds one token in one column for the documents of one
block (a range of BLOCK ids), with all positions.  Where a search needs several
words, blocks that lack one of them are left out by the rows' heads, before
documents and positions are read.

    index = TextIndex.build(spark, path, docs, {"text": "text", "title": "source"})
    index.search('apache NEAR/3 license -title:src7 "lower case" lic*')

Words side by side all have to be there; AND, OR and NOT are written in capitals,
NOT and a leading minus exclude, quotes make a phrase, a star ends a prefix,
column: in front of a term looks there only, NEAR or NEAR/n joins two words,
brackets group.  AND binds closer than OR.  An open quote or bracket ends with the
query; an operator without a term, a bracket that closes nothing and a term
without letters or digits are left out.  A query of exclusions alone finds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.search import fold
from gritstone.session import scratch_path

#: Ids of a block, words that NEAR allows between its two, and words of a snippet.
BLOCK, NEAR, SNIPPET = 1024, 10, 32
#: Files of a bucket in a segment, at most.
PARTS = 4
SCHEMA = "token string, col string, block long, ids array<long>, spots array<int>, bucket int"
WORD = r"[\p{L}\p{N}]+"


# What a query asks for.


@dataclass(frozen=True)
class Term:
    """One word, a prefix, a phrase of several words, or two words at most ``near`` words apart; column None: any."""

    words: tuple[str, ...]
    prefix: bool = False
    near: int | None = None
    column: str | None = None


@dataclass(frozen=True)
class All:
    parts: tuple = ()
    without: tuple = ()


@dataclass(frozen=True)
class Some:
    parts: tuple = ()


Query = Term | All | Some
_TOKENS = re.compile(r'(?P<minus>-)?(?:(?P<column>\w+):)?"(?P<phrase>[^"]*)"?|(?P<bracket>[()])|(?P<plain>[^\s()"]+)')
_FOLDED = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def _words(text: str) -> tuple[str, ...]:
    """The words of a query as the index has them."""
    return tuple(w for w in re.findall(r"[^\W_]+", text.lower().translate(_FOLDED)))


def understand(text: str, columns: tuple[str, ...]) -> Query | None:
    """What a typed query asks for; None if that is nothing."""
    found = [m for m in _TOKENS.finditer(text)]
    at = 0

    def term(m: re.Match) -> tuple[bool, Term | None]:
        raw = m["plain"] or ""
        minus, column, body = bool(m["minus"]), m["column"], m["phrase"]
        if m["plain"]:
            minus, raw = raw.startswith("-"), raw.lstrip("-")
            head, colon, rest = raw.partition(":")
            column, body = (head, rest) if colon and head in columns else (None, raw)
        elif column not in columns:
            column = None
        words = _words(body)
        return minus, Term(words, bool(m["plain"]) and raw.endswith("*"), None, column) if words else None

    def several() -> Query | None:
        """Parts joined by OR, up to a closing bracket."""
        nonlocal at
        options = [joined()]
        while at < len(found) and found[at]["plain"] == "OR":
            at += 1
            options.append(joined())
        options = [o for o in options if o]
        return options[0] if len(options) == 1 else Some(tuple(options)) if options else None

    def joined() -> Query | None:
        nonlocal at
        parts, without, no, near = [], [], False, None
        while at < len(found) and found[at]["plain"] != "OR":
            m = found[at]
            at += 1
            if m["bracket"] == ")":
                if depth[0]:
                    at -= 1
                    break
                continue
            if m["plain"] == "AND":
                continue
            if m["plain"] == "NOT":
                no = True
                continue
            if m["plain"] and (n := re.fullmatch(r"NEAR(?:/(\d+))?", m["plain"])):
                near = int(n[1] or NEAR)
                continue
            if m["bracket"] == "(":
                depth[0] += 1
                minus, part = False, several()
                if at < len(found) and found[at]["bracket"] == ")":
                    at += 1
                depth[0] -= 1
            else:
                minus, part = term(m)
            if part is None:
                continue
            before = parts[-1] if parts else None
            if near is not None and isinstance(part, Term) and isinstance(before, Term) and len(part.words) == len(before.words) == 1 and before.near is None and not (part.prefix or before.prefix):
                parts[-1] = Term((before.words[0], part.words[0]), False, near, before.column or part.column)
            else:
                (without if no or minus else parts).append(part)
            no, near = False, None
        if not parts:
            return None
        return parts[0] if len(parts) == 1 and not without else All(tuple(parts), tuple(without))

    depth, out = [0], []
    while at < len(found):
        before = at
        if (part := several()) is not None:
            out.append(part)
        at = max(at, before + 1)
    return out[0] if len(out) == 1 else All(tuple(out)) if out else None


def terms(query: Query) -> list[Term]:
    """All terms, each once, in the order in which they stand."""
    if isinstance(query, Term):
        return [query]
    inner = query.parts + (query.without if isinstance(query, All) else ())
    return list(dict.fromkeys(t for p in inner for t in terms(p)))


def needed(query: Query) -> list[Term]:
    """Terms without which no document is found."""
    if isinstance(query, Term):
        return [query]
    return list(dict.fromkeys(t for p in query.parts for t in needed(p))) if isinstance(query, All) else []


def _moved(spots: Column, back: int) -> Column:
    return F.transform(spots, lambda p: p - back) if back else spots


# The index.


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, columns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(token, col, block, ids, spots): where the token stands in the documents of a block, by id and place; both arrays have an entry for each place.

    A row with a null id is left out; of rows with one id and column all places
    count.  Places of a block are gathered within each task before they are
    shuffled, once, each as one number: the id within its block and the place.
    """
    parts = None
    for name, source in columns.items():
        words = F.regexp_extract_all(fold(source), F.lit(WORD), F.lit(0))
        one = docs.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.lit(name).alias("col"), F.posexplode(words).alias("pos", "token"))
        parts = one if parts is None else parts.unionByName(one)
    bits = BLOCK.bit_length() - 1
    packed = F.shiftleft(F.col("id").bitwiseAND(F.lit(BLOCK - 1)), 32).bitwiseOR(F.col("pos").cast("long"))
    parts = parts.select("token", "col", F.shiftright("id", bits).alias("block"), packed.alias("x"))
    rows = parts.groupBy("token", "col", "block").agg(F.sort_array(F.collect_list("x")).alias("x")).withColumn("base", F.shiftleft("block", bits))
    ids = F.transform("x", lambda x: F.col("base") + F.shiftright(x, 32))
    return rows.select("token", "col", "block", ids.alias("ids"), F.transform("x", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("spots"))


@dataclass
class TextIndex:
    """Segments <path>/segment=<n>/bucket=<b>/ of postings; build makes the first, add another one."""

    spark: SparkSession
    path: str
    columns: dict[str, str]
    key: str = "doc_id"
    buckets: int = 64
    segments: list[str] = field(default_factory=list)

    @classmethod
    def build(cls, spark: SparkSession, path: str | None, docs: DataFrame, columns: dict[str, str], key: str = "doc_id", buckets: int = 64) -> TextIndex:
        index = cls(spark, path or scratch_path(spark, "text-index"), columns, key, buckets)
        index.add(docs)
        return index

    def add(self, docs: DataFrame) -> None:
        """Index further documents, with ids that the index hasn't; what is there is not read."""
        name = f"{self.path}/segment={len(self.segments)}"
        rows = postings(docs, self.columns, self.key).withColumn("bucket", _bucket(F.col("token"), self.buckets))
        # A bucket is several files, each sorted: a frequent pair of letters is dealt out by token and block.
        part = F.pmod(F.xxhash64("token", "block"), F.lit(PARTS))
        rows.repartition("bucket", part).sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(name)
        self.segments.append(name)

    def _postings(self, asked: list[Term]) -> DataFrame:
        """The rows of the words of all terms: bucket by bucket, in them by token."""
        whole = sorted({w for t in asked if not t.prefix for w in t.words} | {w for t in asked if t.prefix for w in t.words[:-1]})
        starts = sorted({t.words[-1] for t in asked if t.prefix})
        token = F.col("token")
        fits = reduce(lambda a, b: a | b, [token.startswith(s) for s in starts], token.isin(whole) if whole else F.lit(False))
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(SCHEMA).parquet(s) for s in self.segments])
        if all(len(s) >= 2 for s in starts):
            pairs = [r[0] for r in self.spark.createDataFrame([(w,) for w in [*whole, *starts]], "token string").select(_bucket(token, self.buckets)).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(pairs))
        return rows.where(fits)

    def _spots(self, rows: DataFrame, asked: list[Term], need: list[Term]) -> DataFrame:
        """(id, p0, p1, ...): for each document and term the places (column, position) where it stands."""
        plain = [t for t in need if not t.prefix]
        words = sorted({w for t in plain for w in t.words})
        if len(words) > 1:
            blocks = rows.where(F.col("token").isin(words)).groupBy("block").agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(words)).select("block")
            rows = rows.join(blocks, "block", "left_semi")
        flat = rows.select("token", "col", F.explode(F.arrays_zip("ids", "spots")).alias("x")).select("token", "col", F.col("x.ids").alias("id"), F.col("x.spots").alias("pos"))
        # A place is one number: columns lie so far apart that no phrase or distance reaches from one to the next.
        base = F.create_map(*[F.lit(v) for i, c in enumerate(self.columns) for v in (c, i << 40)])[F.col("col")]
        flat = flat.withColumn("pos", F.col("pos").cast("long") + base)
        gather = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("pos"))))
        singles = sorted({(w, t.column) for t in asked for w in (t.words[:-1] if t.prefix else t.words)} | set(), key=repr)
        within = lambda c: F.lit(True) if c is None else F.col("col") == c
        aggs = [gather((F.col("token") == w) & within(c)).alias(f"w{i}") for i, (w, c) in enumerate(singles)]
        prefixes = sorted({(t.words[-1], t.column) for t in asked if t.prefix}, key=repr)
        aggs += [gather(F.col("token").startswith(w) & within(c)).alias(f"x{i}") for i, (w, c) in enumerate(prefixes)]
        found = flat.groupBy("id").agg(*aggs)

        def spots(t: Term) -> Column:
            column = lambda w: F.col(f"w{singles.index((w, t.column))}")
            last = F.col(f"x{prefixes.index((t.words[-1], t.column))}") if t.prefix else column(t.words[-1])
            if t.near is not None:
                # Every place that a place of the first word reaches, met with those of the second.
                reach = F.flatten(F.transform(column(t.words[0]), lambda p: F.sequence(p - t.near - 1, p + t.near + 1)))
                return F.array_intersect(last, reach)
            starts = [column(w) for w in t.words[:-1]] + [last]
            shifted = [_moved(s, i) for i, s in enumerate(starts)]
            return reduce(F.array_intersect, shifted) if len(shifted) > 1 else F.array_distinct(shifted[0])

        return found.select("id", *[spots(t).alias(f"t{i}") for i, t in enumerate(asked)])

    def search(self, query: str | Query, limit: int | None = None) -> DataFrame:
        """(id, hits, places): documents that meet the query, with the number and the places (column, position) of the terms that aren't excluded; with a limit the best first, ties by id."""
        asked_for = understand(query, tuple(self.columns)) if isinstance(query, str) else query
        empty = f"{self.key} long, hits long, places array<struct<col: string, pos: long>>"
        if asked_for is None or not self.segments:
            return self.spark.createDataFrame([], empty)
        asked = terms(asked_for)
        rows = self._spots(self._postings(asked), asked, needed(asked_for))
        size = lambda t: F.size(f"t{asked.index(t)}")

        def holds(q: Query) -> Column:
            if isinstance(q, Term):
                return size(q) > 0
            if isinstance(q, Some):
                return reduce(lambda a, b: a | b, [holds(p) for p in q.parts])
            return reduce(lambda a, b: a & b, [holds(p) for p in q.parts] + [~holds(p) for p in q.without])

        def wanted(q: Query) -> list[Term]:
            return [q] if isinstance(q, Term) else list(dict.fromkeys(t for p in q.parts for t in wanted(p)))

        counted = [f"t{asked.index(t)}" for t in wanted(asked_for)]
        names = F.array(*[F.lit(c) for c in self.columns])
        places = F.transform(F.array_sort(F.array_distinct(F.concat(*counted))), lambda p: F.struct(F.get(names, F.shiftright(p, 40).cast("int")).alias("col"), p.bitwiseAND(F.lit((1 << 40) - 1)).alias("pos")))
        hits = sum((F.size(c) for c in counted[1:]), F.size(counted[0])).cast("long")
        out = rows.where(holds(asked_for)).select(F.col("id").alias(self.key), hits.alias("hits"), places.alias("places"))
        return out if limit is None else out.orderBy(F.desc("hits"), self.key).limit(limit)

    def snippets(self, found: DataFrame, docs: DataFrame, size: int = SNIPPET, marks: tuple[str, str] = ("[", "]")) -> DataFrame:
        """found with col and snippet: up to ``size`` words around the first place, as they stand in the text; all places in it are marked.

        docs is joined for the documents found only.
        """
        col = F.get("places", 0)
        texts = docs.select(F.col(self.key), *[F.col(source).alias(f"_{name}") for name, source in self.columns.items()])
        rows = found.join(texts, self.key)
        text = reduce(lambda a, b: F.coalesce(a, b), [F.when(col["col"] == name, F.col(f"_{name}")) for name in self.columns])
        # Words as they stand: each with what separates it from the next one.
        words = F.regexp_extract_all(text, F.lit(rf"{WORD}[^\p{{L}}\p{{N}}]*"), F.lit(0))
        first = F.greatest(col["pos"].cast("int") - size // 2, F.lit(0))
        there = F.transform(F.filter("places", lambda p: p["col"] == col["col"]), lambda p: p["pos"].cast("int") - first)
        cut = F.slice(words, first + 1, F.lit(size))
        bare = lambda w: F.regexp_extract(w, WORD, 0)
        marked = F.transform(cut, lambda w, i: F.when(F.array_contains(there, i), F.concat(F.lit(marks[0]), bare(w), F.lit(marks[1]), F.regexp_replace(w, f"^{WORD}", ""))).otherwise(w))
        return rows.select(*found.columns, col["col"].alias("col"), F.rtrim(F.array_join(marked, "")).alias("snippet"))
