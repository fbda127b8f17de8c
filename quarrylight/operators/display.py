"""What a reader of an answer is shown: names, labels, capped confidence, counts, benchmark rows; and what may be cached."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.web import domain

# Titles that say nothing, states of an answer that is not cached, and words of a lone source.
GENERIC_TITLES = ["official site", "home", "homepage", "videos"]
NOT_CACHED = ["needs-token", "model-selection-warning", "generation-error", "clarification"]
LONE = ["", "none", "single", "single_source"]
TITLE_CHARS = 58
MODE_LABELS = {"full": "Full", "local_only": "Local Only", "ai_only": "AI Only", "web_only": "Web Only"}


def source_name(title: Column, url: Column) -> Column:
    """A web source's title, or its host where it has none or one that says nothing."""
    t, d = T.compact(title, TITLE_CHARS), domain(url)
    return F.when(t == "", F.when(d != "", d).otherwise("Web source")).when(F.lower(t).isin(GENERIC_TITLES) & (d != ""), d).otherwise(t)


def support_summary(supported: Column, weak: Column, unsupported: Column) -> Column:
    """ "2/5 supported, 1 weak, 2 unsupported"; empty without claims."""
    n = supported + weak + unsupported
    head = F.format_string("%d/%d supported", supported, n)
    return F.when(n <= 0, "").when((weak > 0) | (unsupported > 0), F.concat(head, F.format_string(", %d weak, %d unsupported", weak, unsupported))).otherwise(head)


def shown_confidence(confidence: Column, unverified: Column, agreement: Column, unsupported: Column, older: Column, conflict: Column, time_sensitive: Column) -> Column:
    """High, Medium or Low as the evidence allows: Low if no claim is verified; Medium at most for an unsupported answer, older local sources, a conflict, or a lone source of something that changes."""
    lone = time_sensitive & F.lower(F.coalesce(agreement, F.lit(""))).isin(LONE)
    lowered = unsupported | older | conflict | F.contains(F.lower(F.coalesce(agreement, F.lit(""))), F.lit("conflict")) | lone
    return F.when(~confidence.isin("High", "Medium", "Low"), confidence).when(unverified, "Low").when((confidence == "High") & lowered, "Medium").otherwise(confidence)


def hybrid_confidence(local: Column, web: Column, model: Column) -> Column:
    """The best of what the streams in use give (null: not in use); the model counts as Medium."""
    has = lambda v: F.coalesce(local == v, F.lit(False)) | F.coalesce(web == v, F.lit(False))
    return F.when(has("High"), "High").when(has("Medium") | model, "Medium").otherwise("Low")


def supporting_sources(n_local: Column, uses_local: Column, counted: Column, sufficient: Column, n_web: Column, uses_web: Column) -> Column:
    """Local sources (else the count that was noted, else one if they sufficed) and web sources, of the streams in use."""
    local = F.when(~uses_local, 0).when(n_local > 0, n_local).when(F.coalesce(counted, F.lit(0)) > 0, counted).when(sufficient, 1).otherwise(0)
    return (local + F.when(uses_web, n_web).otherwise(0)).cast("int")


def flags(confidence: Column, n_local: Column, n_web: Column, used_web: Column, stated: dict[str, Column]) -> dict[str, Column]:
    """The six diagnostic flags that every answer has: what is stated counts, the rest follows from the answer."""
    inferred = {
        "used_local": (n_local > 0) | confidence.isin("local-grounded", "local-web-assisted"), "used_web": used_web | (n_web > 0), "used_model_knowledge": confidence == "model-only",
        "parallel_model_with_web": F.lit(False), "local_sufficient": F.lit(False), "model_sufficient": F.lit(False),
    }
    return {k: F.coalesce(stated[k], v) if k in stated else v for k, v in inferred.items()}


def cacheable(answer: Column, confidence: Column, n_local: Column, n_web: Column) -> Column:
    """An answer that is not empty, no error or question back, and not a guess without sources."""
    return (F.trim(F.coalesce(answer, F.lit(""))) != "") & ~confidence.isin(NOT_CACHED) & ~((confidence == "low") & (n_local == 0) & (n_web == 0))


def cache_key(canonical: Column, question: Column, state: Column, settings: Column, focus: Column) -> Column:
    """One text of what an answer depends on: the question's canonical form, the conversation's state, the settings, the document in focus."""
    asked = F.when(F.coalesce(canonical, F.lit("")) != "", canonical).otherwise(T.squeezed(F.lower(question)))
    return F.concat_ws("\u001f", asked, *(F.coalesce(c, F.lit("")) for c in (state, settings, focus)))


def file_confidence(score: Column, fast: Column, coverage: Column, overlap: Column) -> Column:
    """How sure an answer from local files is, by its best source (null scores: no source)."""
    strong = ((score >= 0.82) & (overlap >= 2)) | ((fast >= 0.68) & (coverage >= 0.34) & (overlap >= 2))
    return F.when(score.isNull(), "Low").when(strong, "High").when((score >= 0.62) | (coverage >= 0.2) | (overlap >= 2), "Medium").otherwise("Low")


def files_are_enough(score: Column, fast: Column, coverage: Column, overlap: Column) -> Column:
    return F.coalesce((score >= 0.84) | ((fast >= 0.68) & (coverage >= 0.34) & (overlap >= 2)), F.lit(False))


def batch_size(average_chars: Column, base: Column, memory_bytes: Column) -> Column:
    """Texts of one embedding batch: twice as many of short ones (512 at most), half of long ones (16 at least), no more than 15 % of the free memory holds."""
    b = F.greatest(F.lit(1), base)
    own = F.when(average_chars >= 2200, F.greatest(F.lit(16), F.floor(b / 2))).otherwise(b)
    each = F.greatest(F.lit(512), F.floor(average_chars * 4)) + 1536 * 4
    safe = F.greatest(F.lit(1), F.floor(F.floor(memory_bytes * 0.15) / each))
    return F.when(average_chars.isNull(), b).when(average_chars <= 450, F.least(F.lit(512), b * 2)).when(memory_bytes.isNull(), own).otherwise(F.least(own, safe)).cast("int")


def benchmark_row(mode: Column, confidence: Column, sources: Column, seconds: Column, faithfulness: Column) -> Column:
    """A strategy's line of the comparison table."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MODE_LABELS.items() for x in kv]), mode), mode)
    share = F.when(faithfulness.isNull(), "N/A").otherwise(F.concat(F.rint(faithfulness * 100).cast("int").cast("string"), F.lit("%")))
    return F.concat(F.lit("| "), label, F.lit(" | "), confidence, F.lit(" | "), sources.cast("string"), F.lit(" | "), F.format_string("%.2fs", seconds), F.lit(" | "), share, F.lit(" |"))
