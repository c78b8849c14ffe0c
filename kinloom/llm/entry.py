"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, exact, language, lexical, license, lines, mixing, quality, simhash, substring, tokens, toxicity


queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_substring": substring.op2_substring,
    "op3_tokens": tokens.op3_tokens,
    "op4_license": license.op4_license,
    "op5_language": language.op5_language,
    "op6_mix": mixing.op6_mix,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_exact": exact.op9_exact,
    "op10_simhash": simhash.op10_simhash,
    "op11_lines": lines.op11_lines,
    "op12_search": lexical.op12_search,
    "op13_align": alignment.op13_align,
}

sql: dict[str, str] = {"op2_substring": substring.OP2_SQL, "op6_mix": mixing.OP6_SQL, "op9_exact": exact.OP9_SQL, "op11_lines": lines.OP11_SQL, "op12_search": lexical.OP12_SQL}
