"""Text repair and normalization as column expressions; only NFKC needs Python (an Arrow UDF).

White space here is Unicode white space and U+001C-U+001F.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T_

SPACE = r"(?U)[\s\x1c-\x1f]"
#: The same characters.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Zero-width marks deleted from sources; vowel marks and the stretch deleted, and letters folded, for scoring.
MARKS = "\u200b\u200e\u200f\ufeff"
VOWELS = "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0670\u0640"
ALEFS, ALEF = "\u0623\u0625\u0622", "\u0627"
#: The prompts, in order.
PROMPTS = [
    "استخرج النص من الصورة.",
    "اقرأ محتوى هذه الصورة واكتبه نصاً.",
    "حوّل هذه الصورة إلى نص ماركداون.",
    "Extract the text from this image.",
    "Convert this document image to markdown.",
]
#: What wraps the names of adapter tensors; short names of the suites.
WRAPPER = "base_model.model."
SUITE_LABELS = {
    "arocrbench_patsocr": "patsocr",
    "arocrbench_arabicocr": "arabicocr",
    "arocrbench_synthesizear": "synthesizear",
    "arocrbench_isippt": "isippt",
    "arocrbench_hindawi": "hindawi",
    "nakba_test": "nakba (newspaper)",
    "sedra_handwritten": "sedra (handwriting)",
    "arocrbench_historyar": "historyar",
    "misraj_dococr": "misraj_dococr",
    "arocrbench_khattparagraph": "khatt (handwritten ¶)",
}
#: White space of ASCII but for the line end.
BLANK = "\t\x0b\f\r\x1c\x1d\x1e\x1f "


#: Ranges of characters that are their own NFKC form and neither combine nor reorder: texts of these alone are normal.
STABLE = "\\x{0}-\\x{7F}\\x{C0}-\\x{131}\\x{134}-\\x{13E}\\x{141}-\\x{148}\\x{14A}-\\x{17E}\\x{386}\\x{388}-\\x{38A}\\x{38E}-\\x{3CE}\\x{400}-\\x{482}\\x{48A}-\\x{52F}\\x{621}-\\x{64A}\\x{200B}-\\x{200F}\\x{2013}-\\x{2016}\\x{2018}-\\x{2023}\\x{FEFF}"


@F.arrow_udf(T_.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array((unicodedata.normalize("NFKC", t) if (t := x.as_py()) is not None else None for x in texts), pa.string(), size=len(texts))


def nfkc(c: Column) -> Column:
    """NFKC form. Only texts with a character outside STABLE leave the JVM."""
    other = (F.octet_length(c) != F.length(c)) & ~c.rlike(rf"^[{STABLE}]*+\z")
    return F.coalesce(_composed(F.when(other, c)), c)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c evaluated once however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    """Without white space at the ends; a text that has none there, which is most, is not walked through."""
    return once(c, lambda x: F.when(F.contains(F.lit(WHITE), F.left(x, F.lit(1))) | F.contains(F.lit(WHITE), F.substring(x, -1, 1)), F.btrim(x, F.lit(WHITE))).otherwise(x))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def source_norm(c: Column, composed: bool = False) -> Column:
    """Repaired source text; `composed` skips NFKC for text known to be stable."""
    c = F.coalesce(c, F.lit(""))
    c = c if composed else nfkc(c)
    marked = lambda x: reduce(or_, (F.contains(x, F.lit(mark)) for mark in MARKS))
    return strip(once(c, lambda x: F.when(marked(x), F.translate(x, MARKS, "")).otherwise(x)))


def eval_norm(c: Column, composed: bool = False, keep_vowels: bool = False) -> Column:
    c = F.coalesce(c, F.lit(""))
    c = c if composed else nfkc(c)
    c = c if keep_vowels else F.translate(c, VOWELS, "")
    return collapse(F.translate(c, ALEFS, ALEF * len(ALEFS)))


def _paired(c: Column, pattern: str, closing: str, to: str) -> Column:
    """Replacement of a pattern that ends in a closing tag; it is searched up to the last such tag only, so that opening
    tags that are never closed do not each look through the rest of the text."""
    rest = F.substring_index(c, closing, -1)
    return F.concat(F.regexp_replace(F.left(c, F.length(c) - F.length(rest)), pattern, to), rest)


def html_to_md(c: Column) -> Column:
    """Bold, italics, underline and paragraphs of simple markup; case-sensitive."""
    c = _paired(_paired(c, r"(?s)<b>(.*?)</b>", "</b>", "**$1**"), r"(?s)<i>(.*?)</i>", "</i>", "*$1*")
    for pattern, to in ((r"</?u>", ""), (r"</p>[\s\x1c-\x1f]*+<p>", "\n\n"), (r"</?p>", "")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def drop_images(c: Column) -> Column:
    """Without image references. What begins like one and is none is passed over as a whole (the first alternative, which
    is put back): all openings in it share the bracket or parenthesis that is missing."""
    none = r"(!\[[^\]]*+(?:\](?!\()|\z|\]\([^)]*+\z))"
    return F.regexp_replace(c, rf"{none}|!\[[^\]]*+\]\([^)]*+\)", "$1")


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def unwrap_fence(c: Column) -> Column:
    """The inside of a text that is one plain or markdown code fence; other texts unchanged."""
    opening = F.regexp_extract(c, r"(?U)^```(?:markdown)?[\s\x1c-\x1f]*\n", 0)
    inside = F.rtrim(F.substring(c, F.length(opening) + 1, F.length(c)), F.lit(WHITE))
    return F.when((opening != "") & inside.endswith("```"), strip(F.left(inside, F.length(inside) - 3))).otherwise(c)


def prompt(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PROMPTS)), (F.pmod(i, F.lit(len(PROMPTS))) + 1).cast("int"))


def probe(c: Column, size: int = 40) -> Column:
    return F.substring(collapse(c), 1, size)


def pipe_lines(c: Column) -> Column:
    """Lines that start and end with a pipe, a second one."""
    bare = F.transform(F.split(c, "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)))
    return F.size(F.filter(bare, lambda line: line.startswith("|") & line.endswith("|") & (F.length(line) > 1)))


def has_md_table(c: Column) -> Column:
    return pipe_lines(c) >= 2


def before_last(c: Column, mark: str = "_") -> Column:
    return F.regexp_replace(c, f"{mark}[^{mark}]*$", "")


def safe_int(c: Column, default: int = 1) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def length_ratio(ref: Column, hyp: Column) -> Column:
    return F.length(hyp) / F.greatest(F.length(ref), F.lit(1))


def tensor_name(c: Column) -> Column:
    """The base tensor that a low-rank factor's tensor patches; null if it is not one. The wrapper's name goes once,
    wherever it stands; language and vision parts lose one level of their names."""
    factor = r"\.lora_[AB]\.weight"
    bare = F.regexp_replace(c, factor, "")
    at = F.instr(bare, WRAPPER)
    bare = F.when(at > 0, F.concat(F.left(bare, at - 1), F.substring(bare, at + len(WRAPPER), F.length(bare)))).otherwise(bare)
    moved = F.when(bare.startswith("model.language_model."), F.concat(F.lit("model."), F.substring(bare, F.lit(22), F.length(bare))))
    moved = moved.when(bare.startswith("model.visual."), F.substring(bare, F.lit(7), F.length(bare))).otherwise(bare)
    return F.when(c.rlike(factor), F.concat(moved, F.lit(".weight")))


def mix_part(spec: Column) -> Column:
    """struct(name, coeff) of `name:coeff`, parted at the last colon."""
    return F.struct(F.regexp_extract(spec, r"(?s)^(.*):([^:]*)$", 1).alias("name"), F.regexp_extract(spec, r"(?s)^(.*):([^:]*)$", 2).try_cast("double").alias("coeff"))


def suite_label(c: Column) -> Column:
    """The short name of a suite; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SUITE_LABELS.items() for x in kv]), c)
