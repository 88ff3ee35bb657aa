"""Sentences of texts in English, French, German and Spanish, as Columns.

A full stop after an abbreviation, a single letter or between digits ends nothing; ellipses and closing quotes stay with their
sentence; a sentence begins with a capital, a digit or an opening sign; lines end sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations before a full stop, of the four languages.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St vs etc e.g i.e Fig No approx M Mme Mlle p.ex cf env bzw z.B d.h u.a usw Nr Hr Fr ca ggf Sr Sra Srta Ud p.ej pág".split()
#: Marks that stand for a protected full stop and for the end of a sentence while a text is cut.
STOP, END = "\x02", "\x01"
_words = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=len, reverse=True))
#: (pattern, replacement with groups 1 to 3 between the marks): in this order; a pattern that takes what a next match needs runs twice.
RULES = [
    (rf"(^|[^\p{{L}}\p{{N}}.])({_words})\.", ("1", "2", STOP)),
    (r"(^|[^\p{L}\p{N}])(\p{Lu})\.", ("1", "2", STOP)),
    (r"([0-9])\.([0-9])", ("1", STOP, "2")),
    (r"([0-9])\.([0-9])", ("1", STOP, "2")),
    (r"([.!?…]+[\"'”»)\]]*)[ \t]+([\p{Lu}\p{N}\"'“«¿¡(\[])", ("1", END, "2")),
    (r"([.!?…]+[\"'”»)\]]*)[ \t]+([\p{Lu}\p{N}\"'“«¿¡(\[])", ("1", END, "2")),
    (r"[\n\r]+", (END,)),
]


def sentences(x: Column) -> Column:
    """The sentences of a text, trimmed, in order; null has none."""
    y = F.coalesce(x, F.lit(""))
    for pattern, to in RULES:
        y = F.regexp_replace(y, pattern, "".join(f"${p}" if p.isdigit() else p for p in to))
    parts = F.transform(F.split(F.translate(y, STOP, "."), END), lambda s: F.regexp_replace(s, r"^[ \t]+|[ \t]+$", ""))
    return F.filter(parts, lambda s: s != "")
