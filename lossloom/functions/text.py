"""Column functions over text, tags and losses. All are built-in expressions (no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossloom import fixed_values as fx

# Unicode white space, spelled out so that the JVM agrees with other engines.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    # Runs to the end and back to the last character that is no space; a search for the end run would try every run.
    return F.regexp_extract(_col(c), rf"(?s)\A{SPACE}*+(.*{NOT_SPACE})?", 1)


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(_col(c), rf"{SPACE}+", " "))


def preview(c: Column | str, n: int) -> Column:
    return F.substring(squeeze(F.coalesce(_col(c), F.lit(""))), 1, n)


def blank_to_null(c: Column | str) -> Column:
    """Empty text counts as missing."""
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cols: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def word_count(c: Column | str) -> Column:
    s = squeeze(F.coalesce(_col(c), F.lit("")))
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)


def has_words(c: Column | str, n: int) -> Column:
    """Whether :func:`word_count` is at least ``n`` (one or more); reads no farther than the first ``n`` words."""
    return F.coalesce(_col(c), F.lit("")).rlike(rf"\A{SPACE}*+(?:{NOT_SPACE}++{SPACE}++){{{n - 1}}}{NOT_SPACE}")


def tokens(c: Column | str) -> Column:
    """White-space tokens; an empty array for blank text."""
    # Only white space at an end leaves an empty piece.
    return F.array_remove(F.split(F.coalesce(_col(c), F.lit("")), rf"{SPACE}+"), "")


# --- losses -----------------------------------------------------------------------------------


def finite_or_null(c: Column | str) -> Column:
    """The value as a double, or null when it cannot be cast, is NaN or infinite."""
    d = _col(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def is_finite(c: Column | str) -> Column:
    return finite_or_null(c).isNotNull()


def round_half_even(c: Column | str) -> Column:
    return F.bround(_col(c), 0).cast("int")


# --- tags -------------------------------------------------------------------------------------


def normalize_tag(c: Column | str) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def path_tag(c: Column | str) -> Column:
    """Tag usable in a path: letters and digits of any script kept, all else an underscore each."""
    cleaned = F.regexp_replace(
        F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""
    )
    return F.coalesce(blank_to_null(cleaned), F.lit("untagged"))


def split_intent(c: Column | str) -> Column:
    """Struct ``(intent, base)`` from an optional ``hard:`` / ``validation:`` prefix."""
    raw = strip(F.coalesce(_col(c), F.lit("")))
    intent = F.nullif(F.lower(F.regexp_extract(raw, r"(?i)\A(hard|validation):", 1)), F.lit(""))
    rest = strip(F.regexp_replace(raw, r"(?i)\A(?:hard|validation):", ""))
    base = F.when(intent.isNull(), raw).otherwise(
        F.coalesce(blank_to_null(rest), F.lit(fx.WIDE_VARIETY))
    )
    return F.struct(F.coalesce(intent, F.lit("normal")).alias("intent"), base.alias("base"))


def base_tag(c: Column | str) -> Column:
    return split_intent(c)["base"]


def hard_tag(c: Column | str) -> Column:
    return _with_prefix(fx.HARD_PREFIX, c)


def validation_tag(c: Column | str) -> Column:
    return _with_prefix(fx.VALIDATION_PREFIX, c)


def _with_prefix(prefix: str, c: Column | str) -> Column:
    return F.concat(
        F.lit(prefix), F.coalesce(blank_to_null(strip(c)), F.lit(fx.WIDE_VARIETY))
    )


def is_exploration(c: Column | str) -> Column:
    """``wide_variety`` or ``wide_variety:*`` once the intent prefix is off."""
    base = F.lower(base_tag(c))
    return (base == fx.WIDE_VARIETY) | base.startswith(fx.WIDE_VARIETY + ":")


def is_wide_variety(c: Column | str) -> Column:
    """Variant on the normalised tag: ``wide_variety`` or ``wide_variety_*``."""
    tag = normalize_tag(base_tag(c))
    return (tag == fx.WIDE_VARIETY) | tag.startswith(fx.WIDE_VARIETY + "_")


def is_category(c: Column | str) -> Column:
    """A normalised tag that names a real category."""
    return F.coalesce(
        (_col(c) != "") & ~_col(c).isin(fx.NON_CATEGORY_TAGS), F.lit(False)
    )


def is_metric_tag(c: Column | str) -> Column:
    """A raw tag that takes part in loss metrics: set and not the ``good`` marker."""
    return F.coalesce((_col(c) != "") & (_col(c) != "good"), F.lit(False))


# --- hashing ----------------------------------------------------------------------------------


def stable_index(n: int | Column, *parts: Column | str) -> Column:
    """Deterministic position in ``0..n-1``: the first 12 hex digits of SHA-256 over ``a|b|...``."""
    seed = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    head = F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(n) if isinstance(n, int) else n).cast("int")


def choose_rotated(options: list[str], *parts: Column | str) -> Column:
    return F.element_at(
        F.array(*[F.lit(o) for o in options]), stable_index(len(options), *parts) + 1
    )


def request_key(prompt: Column | str, model_id: str, cache_version: str, temperature: float) -> Column:
    """Content hash of a request: SHA-256 of compact JSON with keys in alphabetical order."""
    text = strip(F.replace(_col(prompt), F.lit("\r\n"), F.lit("\n")))
    payload = F.to_json(
        F.struct(
            F.lit(cache_version).alias("cache_version"),
            F.lit("instruction_response").alias("kind"),
            F.lit(model_id).alias("model_id"),
            text.alias("prompt"),
            F.lit(temperature).alias("temperature"),
        )
    )
    return F.sha2(payload, 256)


# --- markers and question forms ---------------------------------------------------------------


def _marker_found(text: Column, marker: str) -> Column:
    # The cheap substring test spares the regular expression on nearly every row.
    bounded = rf"(?<![a-z0-9]){re.escape(marker)}(?![a-z0-9])"
    return text.contains(marker) & text.rlike(bounded)


def marker_hits(c: Column | str, markers: dict[str, int]) -> Column:
    """Array of the markers found as whole words in lower-case text, in dictionary order."""
    text = _col(c)
    return F.array_compact(
        F.array(*[F.when(_marker_found(text, m), F.lit(m)) for m in markers])
    )


def marker_score(hits: Column | str, markers: dict[str, int]) -> Column:
    """Summed weight of an array of hits."""
    found = _col(hits)
    by_weight: dict[int, list[str]] = {}
    for marker, weight in markers.items():
        by_weight.setdefault(weight, []).append(marker)
    score = F.lit(0)
    for weight, names in by_weight.items():
        group = F.array(*[F.lit(n) for n in names])
        score = score + F.size(F.array_intersect(found, group)) * weight
    return score


def structured_score(c: Column | str) -> Column:
    return marker_score(
        marker_hits(F.lower(F.coalesce(_col(c), F.lit(""))), fx.STRUCTURED_MARKERS),
        fx.STRUCTURED_MARKERS,
    )


def is_question(c: Column | str) -> Column:
    """A question mark in the first 220 characters of the squeezed text, or a question word first.

    Both tests touch only the start of the text: the opening word is anchored, and only what stands
    before the first question mark is squeezed to see how far in it is.
    """
    text = F.coalesce(_col(c), F.lit(""))
    starts = "|".join(fx.QUESTION_STARTS)
    before = F.ltrim(F.regexp_replace(F.substring_index(text, "?", 1), rf"{SPACE}+", " "))
    return text.rlike(rf"(?i)\A{SPACE}*(?:{starts})(?![\p{{L}}\p{{N}}_])") | (
        text.contains("?") & (F.length(before) < fx.QUESTION_MARK_WINDOW)
    )


def has_context(sample: Column | str, instruct: Column | str) -> Column:
    """A context marker in either text, or a long sample with a question as instruction."""
    s, i = F.coalesce(_col(sample), F.lit("")), F.coalesce(_col(instruct), F.lit(""))
    lower_s, lower_i = F.lower(s), F.lower(i)
    marked = F.lit(False)
    for marker in fx.CONTEXT_MARKERS:
        marked = marked | lower_s.contains(marker) | lower_i.contains(marker)
    return marked | (is_question(i) & has_words(s, fx.CONTEXT_MIN_WORDS))


def is_meta_instruction(c: Column | str) -> Column:
    text = F.lower(squeeze(F.coalesce(_col(c), F.lit(""))))
    hit = F.lit(False)
    for marker in fx.META_INSTRUCTION_MARKERS:
        hit = hit | text.contains(marker)
    return hit


# --- model output -----------------------------------------------------------------------------


def strip_fences(c: Column | str) -> Column:
    """Drop a Markdown code fence around stripped text; an unclosed fence loses its first line."""
    text = _col(c)
    inner = strip(F.regexp_extract(text, rf"(?is)\A```(?:json)?{SPACE}*(.*?){SPACE}*```\z", 1))
    fenced = text.rlike(rf"(?is)\A```(?:json)?{SPACE}*(.*?){SPACE}*```\z")
    body = F.regexp_replace(text, r"\A[^\n]*(\n|\z)", "")
    body = F.regexp_replace(body, rf"(?:\A|\n){SPACE}*```[^\n]*\z", "")
    return F.when(fenced, inner).when(text.startswith("```"), strip(body)).otherwise(text)


def salvage_json(c: Column | str, objects_only: bool = False) -> Column:
    """From the first opening bracket to the last matching closing one, or null."""
    text = _col(c)
    obj = F.nullif(F.instr(text, "{"), F.lit(0))
    arr = F.lit(None).cast("int") if objects_only else F.nullif(F.instr(text, "["), F.lit(0))
    start = F.least(obj, arr)
    closer = F.when(start == obj, F.lit("}")).otherwise(F.lit("]"))
    # position of the last closer, counted from the end
    back = F.length(text) - F.position(closer, F.reverse(text)) + 1
    end = F.when(F.position(closer, text) > 0, back)
    return F.when(end > start, F.substring(text, start, end - start + 1))


def strict_json(c: Column | str) -> Column:
    """Parse JSON text to a VARIANT, null unless the whole text is exactly one value.

    The built-in parser ignores what follows the first value. Trailing text is caught by parsing
    the value inside an array and inside an object: it would have to close both kinds of bracket.
    """
    text = _col(c)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = boxed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(listed, "$[0]", "variant"))


def parse_response(df: DataFrame, col: str) -> DataFrame:
    """Add ``payload``, ``value`` (VARIANT) and ``error``: text parsed whole, else salvaged.

    Works in stages so that each text is computed once, however often the next stage names it.
    """
    staged = (
        df.withColumn("payload", strip(col))
        .withColumn("payload", strip_fences("payload"))
        .withColumn("_saved", salvage_json("payload"))
        .withColumn("value", F.coalesce(strict_json("payload"), strict_json("_saved")))
    )
    error = F.concat(
        F.lit("invalid_json: "),
        F.replace(F.substring("payload", 1, 500), F.lit("\n"), F.lit("\\n")),
    )
    return staged.withColumn("error", F.when(F.col("value").isNull(), error)).drop("_saved")


# --- prompts ----------------------------------------------------------------------------------


def render(template: str | Column, values: dict[str, Column]) -> Column:
    """Fill ``***name***`` placeholders in the given order."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit(f"***{name}***"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def has_unfilled(c: Column | str) -> Column:
    return _col(c).contains("***")


def format_example(
    sample: Column | str, output: Column | str, instruct: Column | str,
    context: Column | str, mode: Column | str,
) -> Column:
    contextual = (
        (_col(mode) == "contextual")
        | blank_to_null(instruct).isNotNull()
        | blank_to_null(context).isNotNull()
    )
    return F.when(
        contextual,
        F.concat(
            F.lit("Instruction:\n"),
            F.coalesce(blank_to_null(instruct), F.lit(fx.DEFAULT_CONTEXT_INSTRUCTION)),
            F.lit("\n\nContext:\n"),
            F.coalesce(blank_to_null(context), _col(sample)),
            F.lit("\n\nOutput:\n"),
            _col(output),
        ),
    ).otherwise(
        F.concat(F.lit("Input:\n"), _col(sample), F.lit("\n\nOutput:\n"), _col(output))
    )


def example_signal(
    sample: Column | str, instruct: Column | str, context: Column | str, mode: Column | str
) -> Column:
    shown = first_filled(context, sample)
    signal = F.concat_ws(
        "; ",
        F.concat(F.lit("mode="), blank_to_null(mode)),
        F.when(blank_to_null(instruct).isNotNull(), F.lit("has_instruction=true")),
        F.when(blank_to_null(context).isNotNull(), F.lit("has_context=true")),
        F.concat(F.lit("sample_words="), F.when(shown.isNotNull(), word_count(shown)).cast("string")),
    )
    return F.coalesce(blank_to_null(signal), F.lit("plain input-output example"))


def sample_prompt(sample: Column | str, instruct: Column | str) -> Column:
    """Prompt shown to the student; the input block is left out when the sample is blank."""
    return F.concat(
        F.lit("### Instruction:\n"),
        strip(instruct),
        F.when(is_blank(sample), F.lit("")).otherwise(
            F.concat(F.lit("\n\n### Input:\n"), strip(sample))
        ),
        F.lit("\n\n### Output:\n"),
    )


def context_policy(forced: Column, input_shape: Column, shape_id: Column) -> Column:
    grounded = F.lit(False)
    for word in fx.CONTEXT_POLICY_KEYWORDS:
        grounded = grounded | input_shape.contains(word)
    return (
        F.when(forced, F.lit(fx.CONTEXT_POLICY["forced"]))
        .when(shape_id == fx.ASSISTANT_QA, F.lit(fx.CONTEXT_POLICY["question"]))
        .when(grounded, F.lit(fx.CONTEXT_POLICY["grounded"]))
        .otherwise(F.lit(fx.CONTEXT_POLICY["optional"]))
    )
