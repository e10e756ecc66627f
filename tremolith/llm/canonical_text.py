"""One consistent form for texts that look the same.

A transducer over grapheme clusters: a table of clusters and their canonical forms is precomputed from rules on the
character database (widths, blanks, characters without visible width, canonical accents) and from the names of letters
of one shape in other alphabets, checked for conflicts, and compiled to one pattern whose longest match at each place is replaced in one pass.
Case, accents, raised digits, fractions, numbered signs and the number of blanks can be seen and stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolith.runtime import few, materialize

#: For the names of each alphabet's letters, the letter of the same shape where there is one. The characters
#: follow from their names in the character database.
SHAPES = {
    "GREEK CAPITAL LETTER": "ALPHA=A BETA=B EPSILON=E ZETA=Z ETA=H IOTA=I KAPPA=K MU=M NU=N OMICRON=O RHO=P TAU=T UPSILON=Y CHI=X YOT=J",
    "GREEK SMALL LETTER": "OMICRON=o NU=v RHO=p UPSILON=u",
    "CYRILLIC CAPITAL LETTER": "A=A VE=B ES=C IE=E EN=H BYELORUSSIAN-UKRAINIAN_I=I JE=J KA=K EM=M O=O ER=P QA=Q DZE=S TE=T WE=W HA=X U=Y STRAIGHT_U=Y KOMI_SJE=G",
    "CYRILLIC SMALL LETTER": "A=a ES=c IE=e O=o ER=p HA=x U=y STRAIGHT_U=y BYELORUSSIAN-UKRAINIAN_I=i JE=j DZE=s KOMI_DE=d QA=q WE=w SHHA=h IZHITSA=v PALOCHKA=l",
    "CYRILLIC LETTER": "PALOCHKA=I",
    "ARMENIAN CAPITAL LETTER": "OH=O TIWN=S SEH=U LIWN=L",
    "ARMENIAN SMALL LETTER": "CO=g HO=h VO=n OH=o ZA=q SEH=u",
    "COPTIC CAPITAL LETTER": "VIDA=B HATE=H IAUDA=I KAPA=K MI=M NI=N O=O RO=P SIMA=C TAU=T UA=Y KHI=X ZATA=Z",
    "COPTIC SMALL LETTER": "O=o SIMA=c",
    "CHEROKEE LETTER": "A=D E=R I=T GO=A GU=J GV=E LA=W LU=M MI=H MU=Y NAH=G NO=Z SI=b DO=V DU=S TLE=L TLI=C TLV=P TSO=K YV=B",
    "LISU LETTER": "A=A BA=B CA=C DA=D E=E FA=F GA=G HA=H I=I JA=J KA=K LA=L MA=M NA=N O=O PA=P ZHA=R SA=S TA=T U=U NGA=V WA=W XA=X YA=Y DZA=Z",
    # letters whose small form has the shape of the capital
    "LATIN LETTER SMALL CAPITAL": "C=c O=o S=s U=u V=v W=w Z=z K=к M=м T=т B=в H=н",
    "LATIN SMALL LETTER": "ALPHA=a SCRIPT_G=g",
    "LATIN LETTER": "RETROFLEX_CLICK=!",
}
#: Signs of the same shape, after the sign that they are written as.
SIGNS = {"-": "‐‑﹣−", ":": "∶꞉", "/": "∕⁄", "’": "ʼ", "μ": "µ", "C": "Ϲ", "c": "ϲ", "j": "ϳ", " ": "⠀"}
#: Pairs that can be told apart by eye, which no rule may merge.
DISTINCT = (("2", "²"), ("6", "⁶"), ("e", "é"), ("e", "E"), ("и", "й"), ("ss", "ß"), ("No", "№"), ("1", "①"), ("½", "1/2"), ("-", "–"), ("l", "I"), ("0", "O"), ("  ", " "), ("", " "), ("'", "’"))
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
#: Format characters that have a visible effect of their own and are kept: Arabic number signs and the like.
_VISIBLE_FORMAT = ("؀", "؁", "؂", "؃", "؄", "؅", "۝", "܏", "࣢")
#: Picture sequences, in which joiners, selectors and modifiers show.
_PICTURE = regex.compile(r"\p{Extended_Pictographic}[️\p{Emoji_Modifier}\U000E0020-\U000E007F]*(?:‍\p{Extended_Pictographic}[️\p{Emoji_Modifier}]*)*|[0-9#*]️⃣")
_SELECTED = regex.compile(r"(?<=\p{Emoji_Presentation})️")


def _invisible(c: str) -> bool:
    """Characters without visible width: those that are ignorable by default (fillers and selectors among them), format
    characters without an effect of their own, and controls but for tabs and line ends."""
    kind = unicodedata.category(c)
    if kind == "Cf":
        return c not in _VISIBLE_FORMAT
    return kind == "Cc" and c not in "\t\n\r" or bool(_IGNORABLE.match(c))


def look_alikes() -> dict[str, str]:
    """Letters and signs after the one of the same shape that they are written as, generated from the names above; numerals
    of one letter are that letter."""
    table: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if source != target and table.setdefault(source, target) != target:
            raise ValueError(f"{source!r} has two shapes: {table[source]!r} and {target!r}")

    for alphabet, pairs in SHAPES.items():
        for pair in pairs.split():
            name, target = pair.split("=")
            add(unicodedata.lookup(f"{alphabet} {name.replace('_', ' ')}"), target)
    for target, sources in SIGNS.items():
        for source in sources:
            add(source, target)
    for code in range(0x2160, 0x2180):
        letter = unicodedata.normalize("NFKC", chr(code))
        if len(letter) == 1:
            add(chr(code), letter)
    return table


def _settled(code: int) -> bool:
    """Blocks whose characters are their own form: printable ASCII, ideographs, Hangul syllables, surrogates, private use."""
    return 32 <= code < 127 or 0x3400 <= code < 0x9FFF or 0xAC00 <= code <= 0xF8FF or 0x20000 <= code < 0x2F800 or 0x30000 <= code < 0xE0000 or code >= 0xE0200


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Canonical forms of single characters; raises on a conflict."""
    table: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"{source!r} has two canonical forms: {table[source]!r} and {target!r}")

    singles = look_alikes()
    for source, target in singles.items():
        add(source, target)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if _settled(code):
            continue
        if _invisible(c):
            add(c, "")
        elif unicodedata.category(c) == "Zs" and c != " ":
            add(c, " ")
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            wide = unicodedata.normalize("NFKC", c)
            add(c, "".join(singles.get(x, x) for x in wide) if wide != " " else " ")
        elif c not in singles:
            parts = unicodedata.normalize("NFD", c)
            form = unicodedata.normalize("NFC", "".join(singles.get(x, x) for x in parts))
            if form != c:
                add(c, form)
    for source, target in table.items():
        again = "".join(table.get(x, x) for x in target)
        if unicodedata.normalize("NFC", again) != target:
            raise ValueError(f"{source!r} maps to {target!r}, which maps on to {again!r}")
    return table


#: What may follow a base character in its cluster: marks, voiced sound marks of half-width kana, and what has no width.
_EXTEND = r"\p{M}ﾞﾟ​-‏⁠-⁤­﻿‪-‮"


@lru_cache(maxsize=1)
def _compiled():
    """The pattern of all clusters that may change."""
    table = mapping()
    singles = "".join(sorted(regex.escape(c) for c in table))
    followed = rf"[^\r\n\t{_EXTEND}][{_EXTEND}]+"
    pattern = regex.compile(rf"(?P<picture>{_PICTURE.pattern})|\r\n|[ᄀ-ᇿ]+|{followed}|[{singles}]|[{_EXTEND}]+")
    # check what must stay apart with the compiled form itself
    for a, b in DISTINCT:
        if _transduce(a, pattern) == _transduce(b, pattern):
            raise ValueError(f"{a!r} and {b!r} look different but have one form")
    return pattern


@lru_cache(maxsize=1 << 16)
def _form(cluster: str) -> str:
    """Canonical form of one cluster that is no picture."""
    table = mapping()
    if cluster == "\r\n":
        return "\n"
    mapped = "".join(table.get(c, c) for c in cluster)
    if len(mapped) < 2:
        return mapped
    # marks after a look-alike compose with the letter that it stands for
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", mapped)))


def _transduce(text: str, pattern) -> str:
    return pattern.sub(lambda m: _SELECTED.sub("", m[0]) if m.lastgroup == "picture" else _form(m[0]), text)


@lru_cache(maxsize=1)
def _single() -> tuple[re.Pattern, re.Pattern]:
    """What tells of a cluster of several characters, and what changes in texts that have none of these.

    Classes within the basic plane, where matching is a table look-up; other planes take the full pattern."""
    starts = [chr(i) for i in range(0x20, 0x10000) if not _settled(i) and (unicodedata.category(chr(i)).startswith("M") or regex.match(f"[{_EXTEND}\u1100-\u11ff]", chr(i)))]
    singles = [re.escape(c) for c in mapping() if c < "\U00010000"]
    return re.compile("[" + "".join(starts) + "\U00010000-\U0010ffff]"), re.compile("[" + "".join(singles) + "]|\r\n")


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; null stays null. Idempotent."""
    if text is None:
        return None
    clusters, singles = _single()
    if clusters.search(text):
        return _transduce(text, _compiled())
    return singles.sub(lambda m: _form(m[0]), text)


def canonical_documents(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """``id`` and ``form`` of every row.

    Null texts give a null form, empty ones an empty one, texts of characters without width alone an empty one. Whole
    texts are read, repeated rows come as often as they are there, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([canonical(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), forms], names=["id", "form"])

    rows = documents.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, form string").withColumnRenamed("id", id)


def _keyed(documents: DataFrame, id: str, text: str) -> DataFrame:  # noqa: A002
    """``id`` and the SHA-256 of ``form`` and ``text`` of every different (id, text) that isn't blank, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([canonical(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), forms], names=["id", "text", "form"])

    rows = documents.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    formed = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, form string")
    digests = formed.where(F.regexp_replace("form", r"(?U)\s+", "") != "").select("id", F.unhex(F.sha2("form", 256)).alias("form"), F.unhex(F.sha2("text", 256)).alias("text"))
    return materialize(digests.distinct(), "forms")


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per form and text its ``copies``; and the forms of several texts (written) with their ``texts`` and ``members``."""
    texts = keyed.groupBy("form", "text").agg(F.count("*").alias("copies"))
    forms = texts.groupBy("form").agg(F.count("*").alias("texts"), F.sum("copies").alias("members")).where("texts > 1")
    return texts, materialize(forms, "classes")


def look_alike_classes(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """One row per document: ``id``, ``class`` (SHA-256 of its form), ``texts`` (different texts of the class) and ``links``
    (documents of the class whose text is another one).

    Nothing is paired: links are the members of a class less the copies of the text. Empty and blank texts, null texts and
    null ids have no row; rows of one id and text are one.
    """
    keyed = _keyed(documents, id, text)
    texts, several = _classes(keyed)
    linked = texts.join(few(several), "form").select("text", "texts", (F.col("members") - F.col("copies")).alias("links"))
    rows = keyed.join(linked, "text", "left")
    return rows.select(F.col("id").alias(id), F.lower(F.hex("form")).alias("class"), F.coalesce("texts", F.lit(1)).alias("texts"), F.coalesce("links", F.lit(0)).alias("links"))


def look_alike_pairs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """Pairs ``a`` < ``b`` of ids whose texts look the same but aren't equal: the classes of several texts, spelled out.

    Only different texts of one class are joined, and then spread to their documents, so exact copies never meet each
    other. Empty and blank texts, null texts and null ids make no pairs; rows of one id and text are one.
    """
    keyed = _keyed(documents, id, text)
    several = few(_classes(keyed)[1].select("form"))
    members = materialize(keyed.join(several, "form", "left_semi"), "members")
    texts = members.select("form", "text").distinct()
    pairs = texts.withColumnRenamed("text", "text_a").join(texts.withColumnRenamed("text", "text_b"), "form").where(F.col("text_a") < F.col("text_b")).select("text_a", "text_b")
    spread = (
        pairs.join(members.select(F.col("text").alias("text_a"), F.col("id").alias("x")), "text_a")
        .join(members.select(F.col("text").alias("text_b"), F.col("id").alias("y")), "text_b")
        .where(F.col("x") != F.col("y"))
    )
    return spread.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
