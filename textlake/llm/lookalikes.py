"""Bringing text that looks the same to one form.

Letters, widths, spaces and invisible characters with a known look are undone by a table. A token that mixes scripts even
then holds a letter the table doesn't know: it is walked through tries of the words of the documents by a weighted edit
automaton, to which look-alikes and ignorables cost nothing and a letter of a foreign script little. Where look-alikes
leave the spelling open, a word takes the one the documents use.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.sources.tables import cut, small

# Letters of other scripts and the Latin letter each looks like, in two rows.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеоѕіјрсухһԁԛԝҮӀѴѵԌӏ"
AS_LATIN = "ABESIJKMHOPCTYXaeosijpcyxhdqwYIVvGl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρϲϳ"
AS_LATIN_TOO = "ABEZHIKMNOPTYXovipcj"
OTHERS = "ՕօՏսոհյզցՍԼᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴⲞⲟⲢⲣⲤⲥⲬⲭꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴɑɡᴄᴏᴠᴡᴢꜱ"
AS_OTHERS = "OoSunhjqgULDRTiAJEWMHGZVSLCPKBOoPpCcXxBPDTGKJCZFMNLSRVHWXYAEIOUagcovwzs"
#: Signs that look like another: hyphens without a break, the Greek mu and the micro sign, the Greek question mark.
SIGNS = {"‑": "-", "‐": "-", "μ": "µ", ";": ";", "·": "·"}

#: Documents in which a spelling must stand to count as canonical.
SPELLED_IN = 5
#: Letters of its own script that a token must have for one of a foreign script to be taken for a look-alike, and letters
#: for each of which one foreign one is allowed.
NATIVE, EACH = 3, 4
# Scripts whose letters can stand inside a word of another of them and be taken for its own.
ALPHABETS = {"LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "GEORGIAN", "TIFINAGH", "GOTHIC", "DESERET"}
#: Documents of one form whose pairs one task makes with all documents of the form.
SALTED = 1000

LIKE = dict(zip(CYRILLIC + GREEK + OTHERS, AS_LATIN + AS_LATIN_TOO + AS_OTHERS, strict=True)) | SIGNS
BACK_CYRILLIC = {b: a for a, b in zip(CYRILLIC, AS_LATIN, strict=True) if a not in "ҮѕіјЅІЈһԁԛԝѴѵԌӀӏ"}
BACK_GREEK = {b: a for a, b in zip(GREEK, AS_LATIN_TOO, strict=True) if a not in "ϲϳ"}
WIDTHS = ("<font>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
TOKEN = re.compile(r"[^\s!-/:-@\[-`{-~¡¿«»‘’“”、。，．]+")


@cache
def ignorable(c: str) -> bool:
    """Whether `c` shows nothing: format characters, variation selectors, fillers."""
    return unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or c in "͏ᅟᅠㅤ឴឵" or "᠋" <= c <= "᠏"


@cache
def plain(c: str) -> str:
    """What one character looks like: widths, ligatures and spaces undone; superscripts, fractions and units kept."""
    if ignorable(c):
        return ""
    if unicodedata.category(c) == "Zs" or c == "\t":
        return " "
    parts = unicodedata.decomposition(c)
    if parts.startswith(WIDTHS) or "ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ":
        c = unicodedata.normalize("NFKC", c)
    return unicodedata.normalize("NFC", "".join(LIKE.get(x, x) for x in unicodedata.normalize("NFD", c)))


def skeleton(text: str) -> str:
    """One form for all texts that look the same: not nice to read in other scripts than Latin, but equal."""
    if text.isascii():
        return text.replace("\t", " ")
    composed = unicodedata.normalize("NFC", text)
    shown = unicodedata.normalize("NFC", "".join(map(plain, composed)))
    # What was composed only now, as of a base and an accent with something invisible between, may look alike again.
    return unicodedata.normalize("NFC", "".join(map(plain, shown)))


@cache
def _script(c: str) -> str:
    """The alphabet of a letter; nothing for signs and other scripts."""
    name = unicodedata.name(c, "").split(" ", 1)[0] if c.isalpha() else ""
    return name if name in ALPHABETS else ""


def foreign(seen: str) -> set[str]:
    """The letters of a token, in its skeleton, that are of another alphabet than most of it; none if there are too many."""
    by = Counter(s for c in unicodedata.normalize("NFD", seen) if (s := _script(c)))
    if len(by) < 2:
        return set()
    own, n = min(by.items(), key=lambda x: (-x[1], x[0]))
    out = [c for c in seen if _script(unicodedata.normalize("NFD", c)[0]) not in ("", own)]
    return set(out) if n >= NATIVE and len(out) <= len(seen) // EACH else set()


def from_table(token: str) -> str:
    """The form a token takes without a vocabulary: its skeleton, in the script of the letters that have no double."""
    s = unicodedata.normalize("NFD", skeleton(token))
    scripts = {_script(c) for c in s if c not in BACK_CYRILLIC and c not in BACK_GREEK} - {""}
    back = BACK_CYRILLIC if scripts == {"CYRILLIC"} else BACK_GREEK if scripts == {"GREEK"} else {}
    return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in s))


class Node:
    """A place in a trie: edges by what their character looks like, and the word that ends here with its count."""

    __slots__ = ("edges", "end")

    def __init__(self):
        self.edges: dict[str, dict[str, Node]] = {}
        self.end: tuple[int, str] | None = None


class Trie:
    """Spellings with their counts, walked with an automaton that takes look-alikes and ignorables at no cost."""

    def __init__(self, spellings: dict[str, int]):
        self.root = Node()
        for word, n in spellings.items():
            node = self.root
            for c in word:
                node = node.edges.setdefault(plain(c), {}).setdefault(c, Node())
            node.end = (n, word)

    def canonical(self, token: str, cost: int = 0, other: int = 1, weak: set[str] | frozenset[str] = frozenset()) -> str | None:
        """The spelling that costs least, of equals the most frequent, then the first; None if none is within `cost`.

        A character that looks like the spelling's costs nothing, as does one that shows nothing; one of the `weak` for any
        letter costs 1; any other change, insertion or deletion costs `other`.
        """
        states = self._skipping({self.root: 0}, cost, other)
        for c in unicodedata.normalize("NFC", token):
            for shown in plain(c):
                nxt: dict[Node, int] = {}
                for node, spent in states.items():
                    for child in node.edges.get(shown, {}).values():
                        nxt[child] = min(spent, nxt.get(child, spent))
                    if shown in weak and spent + 1 <= cost:
                        for look, children in node.edges.items():
                            for child in children.values() if look != shown and look.isalpha() else ():
                                nxt[child] = min(spent + 1, nxt.get(child, cost))
                    if spent + other <= cost:
                        nxt[node] = min(spent + other, nxt.get(node, cost))
                        for look, children in node.edges.items():
                            for child in children.values() if look != shown else ():
                                nxt[child] = min(spent + other, nxt.get(child, cost))
                states = self._skipping(nxt, cost, other)
                if not states:
                    return None
        ends = [(spent, -node.end[0], node.end[1]) for node, spent in states.items() if node.end]
        return min(ends)[2] if ends else None

    @staticmethod
    def _skipping(states: dict[Node, int], cost: int, other: int) -> dict[Node, int]:
        """`states` and those reached by leaving out characters of the spelling."""
        todo = [x for x in states.items() if x[1] + other <= cost]
        while todo:
            node, spent = todo.pop()
            for children in node.edges.values():
                for child in children.values():
                    if spent + other < states.get(child, cost + 1):
                        states[child] = spent + other
                        if spent + 2 * other <= cost:
                            todo.append((child, spent + other))
        return states


WORDS = r"([\p{L}\p{M}\p{Cf}]{2,})"
#: Letters of two scripts beside each other, signs without width aside: any word that mixes scripts has such a place.
MIXED = r"\p{IsLatin}[\p{M}\p{Cf}]*[\p{L}&&[^\p{IsLatin}]]|[\p{L}&&[^\p{IsLatin}]][\p{M}\p{Cf}]*\p{IsLatin}|\p{IsGreek}[\p{M}\p{Cf}]*\p{IsCyrillic}|\p{IsCyrillic}[\p{M}\p{Cf}]*\p{IsGreek}"


def _words(docs: DataFrame, keep: str | None = None, sizes: list[int] | None = None) -> DataFrame:
    """(word): each document's distinct words that match the pattern `keep`, or have one of the sizes."""
    every = F.regexp_extract_all("text", F.lit(WORDS))
    if keep:
        return docs.where(F.col("text").rlike(keep)).select(F.explode(F.array_distinct(F.filter(every, lambda w: w.rlike(keep)))).alias("word"))
    return docs.select(F.explode(F.array_distinct(F.filter(every, lambda w: F.length(w).isin(sizes)))).alias("word"))


def spellings(docs: DataFrame) -> DataFrame:
    """(word, n): words that look otherwise than the table spells them, and the documents they stand in.

    All letters of such a word have doubles in another script, or the table would leave it as it is: there are few of
    them in any language. Counted over all documents; each counts a word once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            keep = [len(w) > 1 and not skeleton(w).isascii() and from_table(w) != w for w in words]
            yield batch.filter(pa.array(keep, pa.bool_()))

    counted = _words(docs, r"[\p{IsCyrillic}\p{IsGreek}]").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SPELLED_IN)
    return counted.mapInArrow(run, "word string, n bigint")


ODD = "token string, seen string, size int, place int, sign string"


def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for token in batch.column(0).to_pylist():
            seen = skeleton(token)
            weak = foreign(seen)
            if weak:
                place = next(i for i, c in enumerate(seen) if c not in weak)
                rows.append((token, seen, len(seen), place, seen[place]))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["token", "seen", "size", "place", "sign"])


def unmixed(docs: DataFrame) -> DataFrame:
    """(token, spelling): tokens of the documents that mix scripts even in the table's form, with the word they look like.

    Such tokens are few. Only words of their length that have the same first letter of their own at its place are
    counted; they make a trie for each length, place and letter, and the automaton takes the tokens through it. A letter
    of the foreign script costs 1, as many as `foreign` allows; of equal words the one in most documents wins.
    """
    tokens = _words(docs, MIXED).distinct().mapInArrow(_odd, ODD)
    tokens = cut(tokens)
    none = docs.sparkSession.createDataFrame([], "token string, spelling string")
    if tokens.isEmpty():
        return none
    keys = tokens.select("size", "place", "sign").distinct()
    sizes = [r.size for r in tokens.select("size").distinct().collect()]  # lengths of words
    words = _words(docs, sizes=sizes).withColumn("size", F.length("word"))
    places = tokens.select(F.col("size").alias("_size"), F.col("place").alias("_place")).distinct()
    signed = words.join(small(places), F.col("size") == F.col("_size")).select("word", "size", F.col("_place").alias("place"), F.substr("word", F.col("_place") + 1, F.lit(1)).alias("sign"))
    asked = signed.join(small(keys), ["size", "place", "sign"], "left_semi")
    counted = asked.groupBy("size", "place", "sign", "word").agg(F.count("*").alias("n")).where((F.col("n") >= SPELLED_IN) & ~F.col("word").rlike(MIXED))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        trie = Trie(dict(zip(right.column("word").to_pylist(), right.column("n").to_pylist(), strict=True)))
        out = []
        for token, seen in zip(left.column("token").to_pylist(), left.column("seen").to_pylist(), strict=True):
            most = len(seen) // EACH
            found = trie.canonical(seen, cost=most, other=most + 1, weak=foreign(seen))
            if found:
                out.append((token, from_table(found)))
        return pa.table([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["token", "spelling"])

    by = ["size", "place", "sign"]
    return cut(tokens.groupBy(*by).cogroup(counted.groupBy(*by)).applyInArrow(walk, "token string, spelling string"))


def canonical(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, canonical): every text in its one form.

    Texts of the same look have equal canonical texts: each token takes its look in the table, in the spelling that the
    documents use where look-alikes leave it open; a token that still mixes scripts takes the word it looks like (see
    `unmixed`). Accents, case, digits, units, fractions, superscripts, line breaks and punctuation stay. ASCII texts stay
    as they are (a tab is a space) and don't leave the JVM. A null text stays null, an empty one empty; repeated rows come
    out repeatedly.
    """
    spark = docs.sparkSession
    keep = [k for k in keep or [] if k not in ("doc_id", "text", "canonical")]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep)
    shared = spark.sparkContext.broadcast({r.word: r.n for r in spellings(own).collect()})  # few in any language
    words = unmixed(own)
    # Documents with such tokens, which are few, bring what they turn into; others bring nothing.
    odd = F.col("text").rlike(MIXED)
    mixed = own.where(odd).select(F.md5("text").alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORDS)))).alias("token")).distinct().join(words, "token")
    turned = mixed.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("_turned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(shared.value), {}

        def one(m: re.Match) -> str:
            token = m[0]
            if token.isascii():
                return token
            if token not in known:
                if len(known) > 200_000:
                    known.clear()
                # The spelling is chosen by what is seen, so that all tokens of one look take the same.
                seen = skeleton(token)
                known[token] = seen if seen.isascii() else trie.canonical(seen) or from_table(token)
            return known[token]

        for batch in batches:
            texts = []
            for text, own_words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for token, spelling in sorted(own_words or (), key=lambda x: (-len(x[0]), x[0])):
                    text = re.sub(rf"(?<![^\W\d_]){re.escape(token)}(?![^\W\d_])", spelling, text)
                texts.append(TOKEN.sub(one, separated(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:]], names=["doc_id", "canonical", *batch.schema.names[3:]])

    kept = [f for f in own.schema if f.name in keep]
    schema = ", ".join(["doc_id bigint", "canonical string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    wide = F.col("text").rlike(r"[^\x00-\x7f]")
    nothing = F.lit(None).cast("map<string,string>").alias("_turned")
    plain_ = own.where(wide & ~odd).select("doc_id", "text", nothing, *keep)
    joined = own.where(odd).withColumn("_key", F.md5("text")).join(turned, "_key", "left").select("doc_id", "text", "_turned", *keep)
    beyond = plain_.unionByName(joined).mapInArrow(run, schema)
    rest = own.where(~F.coalesce(wide, F.lit(False))).select("doc_id", F.translate("text", "\t", " ").alias("canonical"), *keep)
    return beyond.select("doc_id", "canonical", *keep).unionByName(rest)


@cache
def _double(c: str) -> bool:
    """Whether a letter, accents aside, has a double in another script."""
    base = unicodedata.normalize("NFD", c)[:1]
    return base in LIKE and base not in SIGNS


def separated(text: str) -> str:
    """`text` composed, and with all that doesn't depend on a word's script in its one form, ready to be cut at tokens."""
    composed = unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", "".join(c if _double(c) else plain(c) for c in composed))


def same_look(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of documents whose texts differ in code points but have one canonical form.

    Texts meet by a 128-bit hash of the canonical form. Of a form that more than SALTED documents hold, one side goes to
    several tasks by a salt and the other side to all of them. Nulls and copies alone give no pair.
    """
    whole = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.md5("text").alias("exact"))
    keyed = cut(canonical(whole, ["exact"]).select("doc_id", F.md5("canonical").alias("form"), "exact"))
    several = keyed.groupBy("form").agg(F.count("*").alias("n"), F.min("exact").alias("low"), F.max("exact").alias("high")).where("low < high")
    every = keyed.join(several.select("form", F.ceil(F.col("n") / SALTED).cast("int").alias("salts")), "form").distinct()
    a = every.select("form", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.col("doc_id").alias("a"), F.col("exact").alias("x"))
    b = every.select("form", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("doc_id").alias("b"), F.col("exact").alias("y"))
    return a.join(b, ["form", "salt"]).where("a < b and x != y").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).distinct()


def look_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group, spelling): every document with the least id of those that read the same, and of its exact copies.

    Two documents read the same if they are of one group, and are stored alike if they are of one spelling, so that this
    holds all pairs of same_look in one row a document. Minima are made partly before the shuffle. Null ids and texts are
    left out; repeated rows come out once.
    """
    whole = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.md5("text").alias("exact"))
    keyed = cut(canonical(whole, ["exact"]).select("doc_id", F.md5("canonical").alias("form"), "exact"))
    spelled = keyed.groupBy("form", "exact").agg(F.min("doc_id").alias("spelling"), F.count("*").alias("n"))
    forms = spelled.groupBy("form").agg(F.min("spelling").alias("group"), F.count("*").alias("spellings"), F.sum("n").alias("n"))
    # A document alone in its form is its own group; the others are few enough to be joined.
    several = spelled.drop("n").join(forms.where("n > 1").select("form", "group"), "form")
    return keyed.join(several, ["form", "exact"], "left").select("doc_id", F.coalesce("group", "doc_id").alias("group"), F.coalesce("spelling", "doc_id").alias("spelling")).distinct()
