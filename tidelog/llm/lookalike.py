"""One consistent form of texts that look alike but differ in their characters."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.operators.skew import salted_join
from tidelog.session import cluster, stage

# Letters of other scripts and, below each, the letters that they are drawn like; a selection of the single letters of Unicode's list of confusables.
SCRIPTS = {
    "Cyrillic, small": ("асԁеһіјӏорԛѕѵԝхуѡ", "acdehijlopqsvwxyw"),
    "Cyrillic, capital": ("АВСЕНІЈКМОРԚЅТѴԜХУҮӀԌ", "ABCEHIJKMOPQSTVWXYYIG"),
    "Greek, small": ("αγινορυϲϳ", "ayivopucj"),
    "Greek, capital": ("ΑΒϹΕΗΙΚΜΝΟΡΤΥΧΖͿϜ", "ABCEHIKMNOPTYXZJF"),
    "Greek capitals drawn like Cyrillic ones": ("ΓΠΦ", "ГПФ"),
    "Armenian": ("օհոսՕՍՏ", "ohnuOUS"),
    "Cherokee": ("ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏳᏴᎥᏂᏏᏧ", "DRTYAJEWMHYGZRWSVSLCPKGBihbd"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Coptic": ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"),
    "Canadian syllabics": ("ᐯᑌᑭᒍᒪᕼᖇᖴᗞᗰᗷ", "VUPJLHRFDMB"),
    "Phonetic": ("ɑɡ", "ag"),
}


def _alike() -> dict[str, str]:
    """SCRIPTS letter by letter, and by rule: letters in the fonts of formulas, and Roman numerals of one letter."""
    known = {a: b for letters, drawn in SCRIPTS.values() for a, b in zip(letters, drawn, strict=True)}
    for c in map(chr, (*range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0x1D400, 0x1D7CC))):
        kind, *codes = unicodedata.decomposition(c).split() or [""]
        if len(codes) == 1 and (kind == "<font>" or kind == "<compat>" and unicodedata.category(c) == "Nl"):
            known[c] = chr(int(codes[0], 16))
    return {a: known.get(b, b) for a, b in known.items()}


#: Characters and the letters that they are drawn like.
ALIKE = _alike()
# Code points that show nothing, as first and last of each range.
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Characters that separate words, besides the blanks (category Zs).
BREAKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"

_HIDDEN = {chr(c) for a, b in INVISIBLE for c in range(a, b + 1)}
_BLANKS = {c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Zs"}
_SPACES = str.maketrans({c: " " for c in _BLANKS})
_WORD = re.compile(f"[^ {BREAKS}]+")


@lru_cache(100_000)
def narrow(c: str) -> str:
    """A character in its usual width; of others, itself."""
    d = unicodedata.decomposition(c)
    return chr(int(d.split()[1], 16)) if d.startswith(("<wide>", "<narrow>")) else c


def spell_out(text: str) -> str:
    """Usual widths, accents apart and in canonical order, without characters that show nothing."""
    return text if text.isascii() else unicodedata.normalize("NFD", "".join(narrow(c) for c in text if c not in _HIDDEN))


def fold(text: str) -> str:
    """Normalisation by table: the form of a text in which look-alikes are the letters of :data:`ALIKE` and accents are composed."""
    return unicodedata.normalize("NFC", "".join(ALIKE.get(c, c) for c in spell_out(text)))


#: For each character, those drawn alike, itself first: the zero-cost substitutions.
_TWINS: dict[str, tuple[str, ...]] = {}
for _c, _to in ALIKE.items():
    _TWINS[_to] = (*_TWINS.get(_to, (_to,)), _c)
for _group in list(_TWINS.values()):
    _TWINS |= {c: (c, *(x for x in _group if x != c)) for c in _group}


@lru_cache(100_000)
def _script(c: str) -> str | None:
    """The script of a letter by its name; none for other characters."""
    return unicodedata.name(c, "?").split(" ")[0] if unicodedata.category(c)[0] == "L" else None


def well_spelled(token: str) -> bool:
    """Whether a token is a spelling to keep: one script, composed accents, usual widths, nothing hidden."""
    if token.isascii():
        return True
    plain = spell_out(token)
    return unicodedata.normalize("NFC", plain) == token and len({s for s in map(_script, plain) if s}) <= 1


def _rank(token: str, count: int) -> tuple:
    """Sorts the spellings of a class: all Latin first, then the most frequent, then by code points."""
    return (not token.isascii() and (fold(token) != token or not {s for s in map(_script, spell_out(token)) if s} <= {"LATIN"}), -count, token)


class _Edge:
    """A stretch of characters, the edges that follow by their first character, and the best spelling that ends with it."""

    __slots__ = ("label", "after", "best")

    def __init__(self, label: str, after: dict[str, _Edge], best: tuple | None):
        self.label, self.after, self.best = label, after, best


class Trie:
    """Spelled-out words of a vocabulary; characters that no word branches at share an edge, so a word of any length is few edges."""

    def __init__(self):
        self.root = _Edge("", {}, None)

    def add(self, token: str, count: int) -> None:
        rest, at, entry = spell_out(token), self.root, (_rank(token, count), token)
        while rest:
            edge = at.after.get(rest[0])
            if edge is None:
                at.after[rest[0]] = _Edge(rest, {}, entry)
                return
            n = len(os.path.commonprefix([edge.label, rest]))
            if n < len(edge.label):  # branch inside the edge
                edge.after, edge.best = {edge.label[n]: _Edge(edge.label[n:], edge.after, edge.best)}, None
                edge.label = edge.label[:n]
            at, rest = edge, rest[n:]
        at.best = entry if at.best is None else min(at.best, entry)

    def match(self, token: str, limit: int = 0) -> str | None:
        """The best spelling within ``limit`` edits, where look-alikes, widths and hidden characters cost nothing.

        The automaton's state holds the least cost at which each place of the trie can be reached, a place being
        an edge and how far along it. A character moves each place to those next to it, at no cost if drawn
        alike, else at 1; it can also be one too many (the place stays) or follow characters that are missing
        (places further on), at 1 each. At limit 0, which keeps apart whatever reads differently, a place has
        few successors and dead states are left at once. The spelling of least cost wins, then of least rank.
        """
        states: dict[tuple[int, int], tuple[int, _Edge, int]] = {}

        def reach(cost: int, edge: _Edge, i: int, into: dict) -> None:
            if cost <= limit and ((id(edge), i) not in into or into[id(edge), i][0] > cost):
                into[id(edge), i] = (cost, edge, i)
                if cost < limit:  # characters that the token misses
                    for _, e, j in _next(edge, i):
                        reach(cost + 1, e, j, into)

        reach(0, self.root, 0, states)
        for c in spell_out(token):
            twins, reached = _TWINS.get(c, (c,)), {}
            for cost, edge, i in states.values():
                if cost < limit:
                    for x, e, j in _next(edge, i):
                        reach(cost + (x not in twins), e, j, reached)
                    reach(cost + 1, edge, i, reached)
                elif i < len(edge.label):
                    if edge.label[i] in twins:
                        reach(cost, edge, i + 1, reached)
                else:
                    for t in twins:
                        if t in edge.after:
                            reach(cost, edge.after[t], 1, reached)
            states = reached
            if not states:
                return None
        ends = [(cost, *edge.best) for cost, edge, i in states.values() if i == len(edge.label) and edge.best]
        return min(ends)[-1] if ends else None


def _next(edge: _Edge, i: int) -> Iterator[tuple[str, _Edge, int]]:
    """The characters that can follow a place, each with the place after it."""
    if i < len(edge.label):
        yield edge.label[i], edge, i + 1
    else:
        for c, e in edge.after.items():
            yield c, e, 1


def _char_class(chars: set[str]) -> str:
    """A regular expression's character class, as ranges."""
    points, ranges = sorted(map(ord, chars)), []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges)


# Ranges of letters and signs that have no twin in another script, as first and last code point.
_PLAIN_RANGES = [(0x80, 0x2FF), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x2190, 0x23FF), (0x2500, 0x27BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF)]
@lru_cache(1)
def _odd() -> str:
    """For rlike(): a character to look at, that is one that a settled text doesn't have, or that a spelling may mix with look-alikes."""
    other = _BLANKS | _HIDDEN
    plain = (chr(c) for a, b in _PLAIN_RANGES for c in range(a, b + 1))
    return f"[^\\x00-\\x7F{_char_class({c for c in plain if fold(c) == c and not unicodedata.combining(c) and c not in other})}]"


_SPLIT = "[" + _char_class(_BLANKS | set(BREAKS) | {" "}) + "]+"


@lru_cache(1)
def _bare() -> tuple[str, str]:
    """For translate(): characters whose first visible base letter is another, then those that count for none (left out).

    None is what can stand behind a base letter in the canonical decomposition of some character, such as accents.
    """
    assigned = (c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) not in ("Cn", "Co"))
    apart = {c: unicodedata.normalize("NFD", fold(c)) for c in assigned}
    behind = {x for d in apart.values() for x in d[1:]}
    change, drop = [], []
    for c, d in apart.items():
        to = d[:1]
        if not to or to in behind or unicodedata.combining(to):
            drop.append(c)
        elif to != c:
            change.append((c, to))
    return "".join(c for c, _ in change) + "".join(drop), "".join(t for _, t in change)


def reading_key(token: Column) -> Column:
    """A hash, equal for tokens that read the same: that of their base letters."""
    return F.xxhash64(F.when(is_ascii(token), token).otherwise(F.translate(token, *_bare())))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def to_look_at(text: Column) -> Column:
    return ~is_ascii(text) & text.rlike(_odd())


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Canonical spellings of asked tokens; rows come sorted by bucket, its well-spelled tokens first, so one bucket's trie is all that is held."""
    schema = pa.schema([("token", pa.string()), ("n", pa.int64()), ("spelling", pa.string())])
    at, trie, waiting, done = None, Trie(), [], []

    def ask(token: str, n: int) -> None:
        spelling = trie.match(token)
        if (spelling := fold(token) if spelling is None else spelling) != token:
            done.append((token, n, spelling))

    def close() -> None:
        for w in waiting:  # words of the trie themselves
            ask(*w)
        waiting.clear()

    for b in batches:
        for bucket, well, token, n, asked in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != at:
                close()
                at, trie = bucket, Trie()
            if well:
                trie.add(token, n)
            if asked:
                if well:
                    waiting.append((token, n))
                else:
                    ask(token, n)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("sha", pa.binary()), ("canonical", pa.string()), ("copies", pa.int64())])
    for b in batches:
        sha, text, pairs, copies = (c.to_pylist() for c in b.columns)
        out = []
        for t, p in zip(text, pairs):
            known = {x["token"]: x["spelling"] for x in p or ()}
            out.append(_WORD.sub(lambda m: known.get(m[0], m[0]), t.translate(_SPACES)))
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(out, pa.string()), pa.array(copies, pa.int64())], schema=schema)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """docs with the columns _text and _sha (32 bytes; null if the text is null)."""
    return docs.withColumn("_text", F.col(text).cast("string")).withColumn("_sha", F.unhex(F.sha2("_text", 256)))


#: Hash values that asked tokens are told by before all tokens are counted: a bound on what is broadcast.
SLOTS = 1 << 20


def _tokens(text: Column) -> Column:
    return F.split(text, _SPLIT)


def spellings(docs: DataFrame, text: str, asked: DataFrame | None = None, trie_words: int = 5000) -> DataFrame:
    """(token, n, spelling) for the tokens of ``docs`` whose canonical spelling is another one, with their number.

    ``asked`` has the tokens to look up (``token``; those of ``docs`` if not given). All tokens of all texts that
    can read the same as one of them are counted: their base letters have the same hash. The hash also deals
    them to buckets of about ``trie_words`` words, so what reads the same is in one bucket, however many words
    share a beginning. Each bucket becomes a trie of its well-spelled tokens, which the automaton traverses for
    each token that is not settled; what matches none is normalised by table.
    """
    every = docs.select(F.explode(_tokens(F.col(text).cast("string"))).alias("token")).where("token <> ''").select("token", reading_key(F.col("token")).alias("key"))
    if asked is None:
        asked = every.where(to_look_at(F.col("token")))
    slot = lambda c: F.pmod(c, F.lit(SLOTS)).alias("slot")
    slots = asked.select(slot(reading_key(F.col("token")))).distinct()  # at most SLOTS rows
    some = every.select("token", "key", slot(F.col("key"))).join(F.broadcast(slots), "slot", "left_semi")
    counted = stage(some.groupBy("token", "key").agg(F.count(F.lit(1)).alias("n")))
    buckets = F.lit(max(1, counted.count() // trie_words))

    @F.arrow_udf("boolean")
    def well(token: pa.Array) -> pa.Array:
        return pa.array([well_spelled(t) for t in token.to_pylist()], pa.bool_())

    ask, text_is_ascii = to_look_at(F.col("token")), is_ascii(F.col("token"))
    rows = counted.select(F.pmod("key", buckets).alias("bucket"), "token", "n", ask.alias("ask"))
    rows = rows.where(text_is_ascii).withColumn("well", F.lit(True)).unionByName(rows.where(~text_is_ascii).withColumn("well", well("token")))
    return cluster(rows.select("bucket", F.when(F.col("well"), 1).otherwise(0).alias("well"), "token", "n", "ask"), ["bucket"], [F.desc("well")]).mapInArrow(_spell, "token string, n bigint, spelling string")


def _changed_texts(docs: DataFrame, text: str) -> DataFrame:
    """(sha, canonical, copies) of the distinct texts that have characters to look at, and how many rows hold each."""
    looked = _texts(docs, text).where(to_look_at(F.col("_text"))).select(F.col("_sha").alias("sha"), F.col("_text").alias("text"))
    texts = stage(looked.groupBy("sha").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    parts = stage(texts.select("sha", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("token")).where(to_look_at(F.col("token"))))
    known = stage(spellings(docs, text, parts))
    pairs = salted_join(parts, known, ["token"], "n", F.col("sha")).groupBy("sha").agg(F.collect_list(F.struct("token", "spelling")).alias("pairs"))
    return texts.join(pairs, "sha", "left").select("sha", "text", "pairs", "copies").mapInArrow(_rewrite, "sha binary, canonical string, copies bigint")


def canonical_texts(docs: DataFrame, text: str, output: str = "canonical") -> DataFrame:
    """``docs`` with a column ``output``: one form of each text, equal for all texts that read the same.

    No difference to the reader is: the width of a character, an accent stored with its letter or apart,
    characters that show nothing, the sort of a blank, letters of different scripts drawn alike. Everything
    else stays: case, digits, punctuation, accents, line breaks, the number of blanks. Words take the
    canonical spelling of the vocabulary (see :func:`spellings`), so a Cyrillic word stays Cyrillic where
    its texts spell it so. Null stays null, an empty text empty; repeated rows, ties and empty tables are
    fine; all other columns are kept (an existing column ``output`` is replaced).

    Only texts with characters to look at are rewritten, each distinct one once; the occurrences of frequent
    words, and the copies of frequent texts, are split by their counts. All other rows pass without a shuffle.
    """
    changed = stage(_changed_texts(docs.select(text), text))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).cast("string").alias("_own"), F.coalesce(to_look_at(F.col(text).cast("string")), F.lit(False)).alias("_look"))
    plain = rows.where("not _look").select("_row", F.col("_own").alias("canonical"))
    looked = _texts(rows.where("_look"), "_own").select("_row", F.col("_sha").alias("sha"))
    # copies of one text go to parts by their other columns (of types that have a hash) and by where they are read
    columns = [F.col("_row")[f.name] for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    joined = salted_join(looked, changed, ["sha"], "copies", F.struct(F.spark_partition_id(), *columns)).select("_row", "canonical")
    return plain.unionByName(joined).select(*(F.col("_row")[c].alias(c) for c in docs.columns if c != output), F.col("canonical").alias(output))


def _forms(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, sha, look) of the documents with non-empty texts, by the hash of the text as stored, and (sha, form, copies) of their distinct texts.

    The second has texts with characters to look at, and those that one of them reads the same as; ``form`` is the
    hash of the canonical text, which of any other text is ``sha``. Nothing is joined to single documents.
    """
    full = docs.where(F.octet_length(F.col(text).cast("string")) > 0).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = stage(_texts(full, "text").select("id", F.col("_sha").alias("sha"), to_look_at(F.col("_text")).alias("look")))
    changed = stage(_changed_texts(full, "text").select("sha", F.unhex(F.sha2("canonical", 256)).alias("form"), "copies"))
    counts = known.where("not look").groupBy("sha").agg(F.count(F.lit(1)).alias("copies"))
    settled = counts.join(changed.select(F.col("form").alias("sha")).distinct(), "sha", "left_semi").select("sha", F.col("sha").alias("form"), "copies")
    return known, stage(changed.unionByName(settled))


def look_alike_classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(<doc_id>, form, class_size, links) of the documents that look like another one: one row per document.

    ``form`` is the SHA-256 of the canonical text, equal for all that read the same; ``links`` is the number of
    documents of the class that differ as stored. Copies are counted, never paired, so a class may hold any
    share of all rows. Null and empty texts have no class; repeated rows count as documents of their own.
    """
    known, stored = _forms(docs, doc_id, text)
    whole = stored.groupBy("form").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")).where("texts > 1").drop("texts")
    links = stage(stored.join(whole, "form").select("sha", "form", "class_size", (F.col("class_size") - F.col("copies")).alias("links"), "copies"))
    return salted_join(known.select("id", "sha"), links, ["sha"], "copies", F.struct(F.spark_partition_id(), "id")).select(F.col("id").alias(doc_id), F.hex("form").alias("form"), "class_size", "links")


def look_alike_pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(<doc_id>_a, <doc_id>_b), a < b: documents with non-empty texts that differ as stored but read the same.

    Texts are compared by the SHA-256 of their canonical forms. First the distinct stored forms of one
    canonical form are paired, which are few however many copies they have; then the copies are attached.
    The result is as long as there are pairs; :func:`look_alike_classes` says the same in a row per document.
    """
    known, stored = _forms(docs, doc_id, text)
    several = stored.groupBy("form").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("form")
    stored = stage(stored.join(several, "form"))
    ids = stage(salted_join(known.select("id", "sha"), stored.select("sha", "copies"), ["sha"], "copies", F.struct(F.spark_partition_id(), "id")))
    pairs = stored.select("form", F.col("sha").alias("sha_a")).join(stored.select("form", F.col("sha").alias("sha_b")), "form").where("sha_a < sha_b").select("sha_a", "sha_b")
    a, b = (ids.select(F.col("sha").alias(f"sha_{x}"), F.col("id").alias(x)) for x in "ab")
    both = pairs.join(a, "sha_a").join(b, "sha_b").where("a <> b")
    return both.select(F.least("a", "b").alias(f"{doc_id}_a"), F.greatest("a", "b").alias(f"{doc_id}_b")).distinct()
