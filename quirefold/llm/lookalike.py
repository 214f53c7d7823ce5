"""One consistent form for texts that look the same.

The characters of all texts that can change, each with the marks that follow
it (a cluster), make a dictionary that is far smaller than the texts. Its
clusters are exploded to positioned code points, which are joined with the
tables of decompositions and look-alikes, put in the order of their combining
classes, and recomposed; the texts are rebuilt with the result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirefold.session import cut_lineage

#: Clusters of the dictionary that tasks hold in full; a larger one is joined
#: with the clusters of the texts.
HELD = 200_000
#: Texts of one look that are paired in one task.
CLASS_ROWS = 2_000

# Letters that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i", "υ": "u", "ρ": "p",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Օ": "O", "Տ": "S", "Ս": "U",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Latin letters of other shapes
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}

#: Blanks of one line become a space; a line break is seen and stays.
_LINE = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
#: Characters without a look of their own besides those of category Cf.
_INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Marks of category Cf that are seen: Arabic and other number signs.
_SEEN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


@lru_cache(maxsize=1)
def decompositions() -> pd.DataFrame:
    """code, target: what each code point is made of that doesn't stay itself,
    from the Unicode data of Python: compatibility forms and composed letters
    taken apart, blanks made one, invisible characters gone. Code points not
    listed stay. About 17,000 rows, a bound given by Unicode; Hangul syllables
    are composed of their letters by rule and stay."""
    codes, targets = [], []
    gone = set(_INVISIBLE)
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if code in gone or (kind == "Cf" and code not in _SEEN):
            target = ""
        elif (kind == "Zs" or c == "\t") and c not in _LINE:
            target = " "
        else:
            target = unicodedata.normalize("NFKD", c)
        if target != c:
            codes.append(code)
            targets.append(target)
    return pd.DataFrame({"code": codes, "target": targets})


@lru_cache(maxsize=1)
def combining() -> pd.DataFrame:
    """code, ccc: the code points with a combining class, below 1,000 rows."""
    rows = [(c, unicodedata.combining(chr(c))) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    return pd.DataFrame(rows, columns=["code", "ccc"])


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Two code points and the one that they are composed to, about 1,000;
    Hangul is composed by rule."""
    out = {}
    for code in range(sys.maxunicode + 1):
        two = unicodedata.decomposition(chr(code)).split()
        if len(two) == 2 and not two[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in two)
            if unicodedata.normalize("NFC", pair) == chr(code):
                out[pair] = chr(code)
    return out


@lru_cache(maxsize=1)
def mapping() -> dict[int, str]:
    """What each code point becomes, look-alikes folded, before it is composed."""
    out = {ord(a): b for a, b in LOOKALIKES.items()}
    for code, target in zip(decompositions()["code"].tolist(), decompositions()["target"].tolist(), strict=True):
        out[code] = "".join(LOOKALIKES.get(x, x) for x in target)
    return out


def form(text: str) -> str:
    """The folded form of one text, computed in one go; the brute force that
    the tests compare the operator with."""
    return unicodedata.normalize("NFC", text.translate(mapping()))


def compose(ordered: str, classes: dict[str, int]) -> str:
    """A decomposed text, whose marks are in the order of their classes, with
    every letter composed with the marks behind it that nothing blocks."""
    pairs = compositions()
    out: list[str] = []
    letter, last = -1, 0  # the last starter's place, the class of what came before
    for c in ordered:
        ccc = classes.get(c, 0)
        if letter >= 0 and (last < ccc or letter == len(out) - 1):
            one = pairs.get(out[letter] + c) or _syllable(out[letter], c)
            if one:
                out[letter] = one
                continue
        out.append(c)
        if ccc == 0:
            letter = len(out) - 1
        last = ccc
    return "".join(out)


def _syllable(a: str, b: str) -> str | None:
    """Hangul: a lead and a vowel, or an open syllable and a final, as one."""
    x, y = ord(a), ord(b)
    if 0x1100 <= x <= 0x1112 and 0x1161 <= y <= 0x1175:
        return chr(0xAC00 + ((x - 0x1100) * 21 + y - 0x1161) * 28)
    if 0xAC00 <= x <= 0xD7A3 and (x - 0xAC00) % 28 == 0 and 0x11A8 <= y <= 0x11C2:
        return chr(x + y - 0x11A7)
    return None


def _ranges(codes: list[int]) -> str:
    """The body of a character class."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """What can belong to the character before it - marks, invisible characters,
    conjoining vowels and finals, voicing marks of half width -, and a
    character with at least one such behind it. A Thai letter with one mark
    above or below stays as it is and is none, for speed."""
    more = {*range(0x1160, 0x1200), *range(0xD7B0, 0xD800), 0xFF9E, 0xFF9F, 0x3164, *range(0xFFA0, 0xFFDD)}
    after = _ranges([c for c in range(sys.maxunicode + 1) if c in more or unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf")])
    thai = "[\u0e01-\u0e2e\u0e40-\u0e44][\u0e31\u0e34-\u0e37\u0e47-\u0e4e]"
    return re.compile(f"[{after}]"), re.compile(f"(?s:(?!{thai}(?![{after}])).[{after}]+)")


#: Characters that stay themselves, if nothing follows that belongs to them.
_STAYS = frozenset(map(chr, range(0x7F))) - {"\t"}


def clusters_of(texts: list[str]) -> set[str]:
    """The clusters of texts that can change: single characters other than
    ASCII, and characters with what belongs to them."""
    after, several = _patterns()
    out: set[str] = set()
    for t in texts:
        if not t.isascii() or "\t" in t:
            out.update(set(t) - _STAYS)
            if after.search(t):
                out.update(several.findall(t))
    return out


def replace_all(text: str, table: dict[str, str]) -> str:
    """A text with its single characters replaced; what they become holds none
    that is replaced. Each kind of character is one fast pass."""
    for c in table.keys() & set(text):
        text = text.replace(c, table[c])
    return text


def rebuild(text: str, single: dict[str, str], several: dict[str, str]) -> str:
    """A text with its clusters replaced: first those of several code points,
    whose results stay themselves, then single characters."""
    if several and not text.isascii():
        after, pattern = _patterns()
        if after.search(text):
            text = pattern.sub(lambda m: several.get(m.group(), m.group()), text)
    return replace_all(text, single)


def _fold(words: DataFrame) -> DataFrame:
    """cluster, plain, look: what the clusters become, without and with
    look-alikes folded; only of those that change. See :func:`one_form`."""
    spark = words.sparkSession
    ccc = combining()
    classes = dict(zip(map(chr, ccc["code"].tolist()), ccc["ccc"].tolist(), strict=True))

    @F.pandas_udf(StringType())
    def recompose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: compose(x, classes), na_action="ignore")

    points = words.select("cluster", F.posexplode(F.split("cluster", "")).alias("at", "c")).where("c <> ''").withColumn("code", F.ascii("c"))
    maps = F.broadcast(spark.createDataFrame(decompositions()))
    alike = F.broadcast(spark.createDataFrame(list(LOOKALIKES.items()), "c string, like string"))
    orders = F.broadcast(spark.createDataFrame(ccc))
    # within a target the order of its characters is kept by posexplode
    parts = (
        points.join(maps, "code", "left")
        .select("cluster", "at", F.posexplode_outer(F.split(F.coalesce("target", "c"), "")).alias("sub", "c"))
        .withColumn("code", F.ascii("c"))
        .join(orders, "code", "left")
        .join(alike, "c", "left")
        .select("cluster", "at", "sub", "c", F.coalesce("like", "c").alias("like"), F.coalesce("ccc", F.lit(0)).alias("ccc"))
    )
    # marks move only behind marks of a lower class, never over a starter: the
    # number of starters so far is the first key of the order; what is gone is none
    so_far = Window.partitionBy("cluster").orderBy("at", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.withColumn("n", F.sum(((F.col("ccc") == 0) & (F.col("c") != "")).cast("int")).over(so_far))
    put = numbered.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("n", "ccc", "at", "sub", "c", "like"))).alias("s"))
    joined = put.select("cluster", *[F.array_join(F.col("s").getField(k), "").alias(k) for k in ("c", "like")])
    out = joined.select("cluster", recompose("c").alias("plain"), recompose("like").alias("look"))
    return out.where((F.col("plain") != F.col("cluster")) | (F.col("look") != F.col("cluster")))


_WORD = re.compile(r"[^\W\d_]+")
_TO_LATIN = {ord(a): b for a, b in LOOKALIKES.items()}


@lru_cache(maxsize=1)
def _scripts() -> dict[str, dict[int, str]]:
    """Of each script, what its look-alikes stand for, from Latin: the first
    letter of the table."""
    out: dict[str, dict[int, str]] = {}
    for a, b in LOOKALIKES.items():
        out.setdefault(_script(a), {}).setdefault(ord(b), a)
    return out


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def one_script(word: str) -> str:
    """A word that mixes scripts in the script of its letters that look like no
    other's; Latin if all do. Others stay."""
    if word.isascii():
        return word
    scripts = {_script(c) for c in word}
    others = scripts & _scripts().keys() - {"LATIN"}
    if "LATIN" not in scripts or not others:
        return word
    own = [_script(c) for c in word if ord(c) not in _TO_LATIN and _script(c) in others]
    return word.translate(_scripts()[max(set(own), key=lambda s: (own.count(s), s))] if own else _TO_LATIN)


def unmixed(text: str) -> str:
    return text if text.isascii() else _WORD.sub(lambda m: one_script(m.group()), text)


def _dictionary(given: DataFrame) -> DataFrame:
    """The distinct clusters of the texts that change, and what they become.
    Each task sends every cluster once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[str] = set()
        for batch in batches:
            new = clusters_of(batch.column(0).to_pylist()) - own
            own |= new
            yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["cluster"])

    return cut_lineage(_fold(given.select("__text").mapInArrow(collect, "cluster string").distinct()))


def one_form(df: DataFrame, text: str, keep: list[str], forms: bool = True, held: int = HELD) -> DataFrame:
    """Every text in its consistent form: the columns of ``keep``, text_key,
    look_key, blank and, with ``forms``, form.

    In ``form``, compatibility forms, composed or combining marks, kinds of
    blank and invisible characters become one, and words that mix scripts have
    one (see :func:`one_script`); so it is fit for training. Letter case,
    accents, digits, quotation marks, line breaks and the number of blanks
    stay, as they can be seen. Texts with the same look_key look the same: it
    is a hash of 128 bits of the form with all look-alikes folded to one
    letter; text_key is that of the text. blank: nothing is seen. Null texts
    give no row, an empty or invisible text has an empty form; repeated rows
    stay; other columns are dropped.

    Plan: one narrow pass gathers the clusters of all texts; the dictionary is
    folded with joins against tables whose sizes Unicode bounds, so that
    broadcasting them is safe. Up to ``held`` changing clusters are given to
    the tasks, which rebuild the texts in a second narrow pass: no text is
    shuffled. A larger dictionary is joined with the clusters of the texts.
    """
    spark = df.sparkSession
    given = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).cast("string").alias("__text"))
    known = _dictionary(given)
    if known.count() > held:
        return _joined(given, known, keep, forms)
    shared = spark.sparkContext.broadcast([tuple(r) for r in known.collect()])  # at most `held`

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, look = (({r[0]: r[k] for r in shared.value if len(r[0]) == 1}, {r[0]: r[k] for r in shared.value if len(r[0]) > 1}) for k in (1, 2))
        for batch in batches:
            yield _keyed(batch, [rebuild(t, *look) for t in batch.column(len(keep)).to_pylist()], [unmixed(rebuild(t, *plain)) for t in batch.column(len(keep)).to_pylist()] if forms else None)

    return given.mapInArrow(work, _schema(given, forms))


def _schema(given: DataFrame, forms: bool) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields if f.name in given.columns[: len(given.columns) - 1]) + "text_key binary, look_key binary, blank boolean" + (", form string" if forms else "")


def _keyed(batch: pa.RecordBatch, looks: list[str], forms: list[str] | None) -> pa.RecordBatch:
    at = batch.num_columns - 1
    keys = ([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts] for texts in (batch.column(at).to_pylist(), looks))
    columns = [*batch.columns[:at], *(pa.array(k, pa.binary()) for k in keys), pa.array([not t.strip() for t in looks], pa.bool_())]
    return pa.RecordBatch.from_arrays([*columns, *([pa.array(forms, pa.string())] if forms is not None else [])], names=[*batch.schema.names[:at], "text_key", "look_key", "blank", *(["form"] if forms is not None else [])])


def _joined(given: DataFrame, known: DataFrame, keep: list[str], forms: bool) -> DataFrame:
    """The same by joins, for dictionaries that tasks shouldn't hold: the
    clusters of each distinct text, exploded, find what they become, and come
    back to it as one list. A frequent cluster is sent once for each text that
    has it, and spread by a salt."""
    texts = given.select("__text").distinct().select(F.md5(F.col("__text").cast("binary")).alias("__id"), "__text")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(clusters_of([t])) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["__id", "clusters"])

    salts = 32
    asked = texts.mapInArrow(explode, "__id string, clusters array<string>").select("__id", F.explode("clusters").alias("cluster"), F.pmod(F.hash("__id"), F.lit(salts)).alias("salt"))
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = asked.join(copies, ["cluster", "salt"]).groupBy("__id").agg(F.collect_list(F.struct("cluster", "plain", "look")).alias("__rows"))
    rows = given.withColumn("__id", F.md5(F.col("__text").cast("binary"))).join(found, "__id", "left").select(*keep, "__rows", "__text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keep)
        for batch in batches:
            looks, plains = [], []
            for t, own in zip(batch.column(at + 1).to_pylist(), batch.column(at).to_pylist(), strict=True):
                for k, out in (("look", looks), ("plain", plains)):
                    single = {r["cluster"]: r[k] for r in own or () if len(r["cluster"]) == 1}
                    out.append(rebuild(t, single, {r["cluster"]: r[k] for r in own or () if len(r["cluster"]) > 1}))
            yield _keyed(pa.RecordBatch.from_arrays([*batch.columns[:at], batch.column(at + 1)], names=[*batch.schema.names[:at], "__text"]), looks, [unmixed(t) for t in plains] if forms else None)

    return rows.mapInArrow(work, _schema(given, forms))


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose texts look like a different one: key, text_key, look_key,
    distinct. Rows of one look_key are one class. Blank texts, and rows without
    key, are in none. No class is brought together in one row or task."""
    rows = one_form(df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("__given")), "__given", ["key"], forms=False)
    rows = rows.where(~F.col("blank")).select("key", "text_key", "look_key").distinct()
    rows = cut_lineage(rows)
    several = rows.groupBy("look_key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("look_key")
    return rows.join(several, "look_key").select("key", "text_key", "look_key")


def same_look(df: DataFrame, key: str, text: str, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Pairs of rows whose texts differ but look the same: key_a < key_b,
    distinct. Blank texts, and rows without key, are in none.

    Plan: hashes of texts and forms are all that is shuffled; only classes of
    two or more different texts (see :func:`look_classes`) are expanded to
    pairs, by a join on the class, a large one dealt over salts.
    """
    members = look_classes(df, key, text)
    sizes = members.groupBy("look_key").agg(F.ceil(F.count(F.lit(1)) / class_rows).cast("int").alias("salts"))
    members = members.join(sizes, "look_key")
    a = members.select("look_key", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.col("key").alias("key_a"), F.col("text_key").alias("ta"))
    b = members.select("look_key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("key_b"), F.col("text_key").alias("tb"))
    return a.join(b, ["look_key", "salt"]).where((F.col("key_a") < F.col("key_b")) & (F.col("ta") != F.col("tb"))).select("key_a", "key_b").distinct()
