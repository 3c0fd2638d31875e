"""One form for texts that look alike."""

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.plans.durable import durable

# Letters of one shape. Each line of the second column has the shapes of the first, letter by letter.
SAME_SHAPE = (
    # Cyrillic and Latin
    ("АВЕЅІЈКМНОРСТХԚԜ", "ABESIJKMHOPCTXQW"),
    ("асԁеһіјорԛѕѵԝху", "acdehijopqsvwxy"),
    ("\u04ae\u04af\u04c0\u04cf\u0474\u050c\u04e0\u04e1", "YyIlVG\u01b7\u0292"),
    # Greek and Latin
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),
    ("αινορυγϲ", "aivopuyc"),
    ("\u037f\u03fa\u03dc\u03f7\u03f8\u03a3", "JMF\u00de\u00fe\u01a9"),
    # Greek and Cyrillic
    ("ΓΠΦκ", "ГПФк"),
    ("\u0470\u0471\u0398\u0376\u0377", "\u03a8\u03c8\u04e8\u0418\u0438"),
    # Within one alphabet, and those for which the one with accented letters of its own stands
    ("\u018f\u0259\u01dd\u00d0\u0189\u019f\u0472\u0473\u0275\u025b\u00b5", "\u04d8\u04d9\u04d9\u0110\u0110\u04e8\u04e8\u04e9\u04e9\u03b5\u03bc"),
)
# Characters without width beside those of category Cf, and those of Cf that are drawn.
WIDTHLESS = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
DRAWN = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))
LINE = "\t\n\x0b\x0c\r\x85" + chr(0x2028) + chr(0x2029)
#: Texts of these characters alone are in their form already.
PLAIN = r"^[\x20-\x7e\t\n\r]*$"


class Shape:
    """Tables of the form, made by rule from the Unicode database."""

    def __init__(self) -> None:
        within = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)
        #: Code point -> what stands for it before composition.
        self.single: dict[int, str] = {}
        #: Base letter -> letter of its shape, after decomposition.
        self.letters = {ord(a): b for source, target in SAME_SHAPE for a, b in zip(source, target, strict=True)}
        unstable = []
        for cp in [*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]:
            if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
                continue
            c = chr(cp)
            kind = unicodedata.category(c)
            tag, _, parts = unicodedata.decomposition(c).rpartition("> ")
            if c in LINE:
                pass
            elif within(cp, WIDTHLESS) or kind == "Cc" or (kind == "Cf" and not within(cp, DRAWN)):
                self.single[cp] = ""
            elif kind == "Zs":
                self.single[cp] = " "
            elif tag in ("<wide", "<narrow"):
                self.single[cp] = "".join(chr(int(x, 16)) for x in parts.split())
            # Quick check: a mark or a letter that may join the one before it, or a character whose form is another.
            if cp > 0xFFFF:  # one range below: the expression stays a table for all others
                continue
            joins = unicodedata.combining(c) or 0x1161 <= cp <= 0x11C2 or kind in ("Mn", "Mc")
            if joins or (cp != 0x20 and (cp in self.single or self.canonical(c) != c)):
                unstable.append(cp)
        #: An unstable stretch with the stable character before it, with which its first mark may join.
        self.segment = "(?s:[^" + (cls := _ranges(unstable) + "\U00010000-\U0010ffff") + "])?[" + cls + "]+"

    def canonical(self, s: str) -> str:
        s = unicodedata.normalize("NFD", s.translate(self.single))
        return unicodedata.normalize("NFC", s.translate(self.letters))

    def former(self):
        """The form of a text: only unstable stretches are normalized and put back between the unchanged ones.

        A plain space joins with nothing, so a text is the sum of what stands between its spaces; short stretches between spaces come again and are remembered."""
        find = re.compile(self.segment)
        part = lambda m: self.canonical(m.group())
        spliced = lambda word: word if word.isascii() and word.isprintable() else find.sub(part, word)
        known = _Remembered(spliced)
        return lambda text: " ".join(map(known.__getitem__, text.split(" ")))


class _Remembered(dict):
    """Results of a function of strings; emptied when it holds a million characters, long strings are not kept."""

    def __init__(self, of):
        self.of, self.size = of, 0

    def __missing__(self, text: str) -> str:
        out = self.of(text)
        if len(text) <= 64:
            if self.size > 1_000_000:
                self.clear()
                self.size = 0
            self[text] = out
            self.size += len(text)
        return out


def _ranges(cps: list[int]) -> str:
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(re.escape(chr(cps[i])) + (f"-{re.escape(chr(cps[j]))}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(1)
def shape() -> Shape:
    return Shape()


def look(text: str) -> str:
    """The form of one text, for tests and drivers."""
    return shape().former()(text)


def with_form(df: DataFrame, text: str, name: str = "form") -> DataFrame:
    """df with the canonical form of a text column: what looks alike is equal.

    Characters without width are dropped (format characters, variation selectors, controls other than tab and line ends), every
    space separator is a plain space, full- and half-width forms are the ordinary characters, letters and accents are
    composed (NFC), and Latin, Greek and Cyrillic letters of one shape are one letter, with their accents. Letter case, missing accents,
    other digits, tabs, line ends and the number of spaces stay as they are. Null gives null, empty gives empty. A column that is
    called `name` already is replaced; all others stay.

    Texts of plain ASCII never leave the JVM; of the others only unstable stretches are normalized.
    """
    tables = shape()

    @F.arrow_udf("string")
    def canon(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        form = tables.former()
        for texts in batches:
            yield pa.array([None if t is None else form(t) for t in texts.to_pylist()], pa.string())

    source = F.col(text)
    return df.withColumn(name, F.coalesce(canon(F.when(~source.rlike(PLAIN), source)), source))


def visible(form: Column) -> Column:
    """True where a form has a character that is drawn."""
    return form.rlike(r"[^ \t\n\x0b\x0c\r\x85\x{2028}\x{2029}]")


def lookalikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Classes of look-alike texts that differ as strings; columns key, class_id (digest of the form), variant (digest of the text).

    Repeated rows are one. A class with only one string has no row here, nor have null texts and texts without any visible character. Digests of 256 bits
    stand for the texts, so long texts are not shuffled; a class is found from one row per distinct string and map task.
    """
    rows = with_form(df.select(key, F.col(text).alias("_text")), "_text", "_form").where(visible(F.col("_form")))
    rows = durable(rows.select(key, F.unhex(F.sha2("_form", 256)).alias("class_id"), F.unhex(F.sha2("_text", 256)).alias("variant")))  # forms are made once
    several = rows.groupBy("class_id").agg(F.min(F.hex("variant")).alias("_a"), F.max(F.hex("variant")).alias("_b")).where("_a <> _b").select("class_id")
    return rows.join(several, "class_id", "left_semi").select(key, "class_id", "variant").distinct()


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every pair of rows whose texts differ as strings but look the same; columns <key>_a, <key>_b, the smaller key first."""
    rows = durable(lookalikes(df, key, text))
    a, b = (rows.select(F.col(key).alias(f"{key}_{x}"), "class_id", F.col("variant").alias(f"_v{x}")) for x in "ab")
    return a.join(b, "class_id").where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("_va") != F.col("_vb"))).select(f"{key}_a", f"{key}_b")


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """The classes of look-alike texts without their pairs, a row per distinct string: representative (the smallest key of the class), variant
    (the smallest key with that string), rows (how many have it). Keys that have the string in several rows count once."""
    rows = lookalikes(df, key, text)
    own = rows.groupBy("class_id", "variant").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("rows"))
    own = durable(own)
    whole = own.groupBy("class_id").agg(F.min("_first").alias("representative"))
    return own.join(whole, "class_id").select("representative", F.col("_first").alias("variant"), "rows")
