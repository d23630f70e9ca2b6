"""Record-level text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.numeric import round_even

# fixed values: prompt template text (system prompt of the agent)
PROMPT_GOAL = "\n\n## Goal\n\n"
PROMPT_INSTRUCTIONS = "\n\n## Instructions\n\n"
PROMPT_LANGUAGE = "\n\n## Language\n\nRespond in "
PROMPT_KNOWLEDGE = (
    ".\n\n## Knowledge Base\n\nYou have access to a knowledge base tool. Always use `search_knowledge_base` "
    "to look up reference material before answering the user's question. Base your response strictly on the "
    "tool results. If the tool returns no relevant content, say so honestly.\n\n")
PROMPT_CLASSES = (
    "\n## Question Categories\n\nClassify the user's message into one of the following categories before "
    "responding. Use the category context to guide your answer.\n\n")
PROMPT_DEFAULT_LANGUAGE = "the user's language"
# fixed values: knowledge-base joiner and empty message
KNOWLEDGE_SEPARATOR = "\n\n---\n\n"
KNOWLEDGE_EMPTY = "No knowledge base content available for this topic."
# fixed values: language code -> name used in prompts
PROMPT_LANGUAGES = {1: "English", 2: "Spanish", 3: "Portuguese"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def class_name_for(classes, chosen_id) -> Column:
    """C10 — class name of the first class whose id equals ``chosen_id`` (NULL if none)."""
    return F.try_element_at(F.filter(_c(classes), lambda c: c["id"] == _c(chosen_id)), F.lit(1))["class"]


def class_exact_match(response, classes, chosen_id) -> Column:
    """H6 + wrapper: NULL (N/A) when there is no expected id or it is not in the class
    list; else the id, or the class name with '_' -> ' ', is a case-insensitive
    substring of the response."""
    name = class_name_for(classes, chosen_id)
    low = F.lower(F.coalesce(_c(response), F.lit("")))
    by_id = F.contains(low, F.lower(_c(chosen_id)))
    by_name = (F.coalesce(name, F.lit("")) != "") & F.contains(low, F.lower(F.regexp_replace(name, "_", " ")))
    applicable = _c(chosen_id).isNotNull() & (_c(chosen_id) != "") & name.isNotNull()
    return F.when(applicable, by_id | by_name)


def render_prompt(name, adjective, occupation, goal, instructions, language, classes) -> Column:
    """H16 — the system prompt: persona, goal, instruction bullets, language name
    (default "the user's language"), and the class list when there is one."""
    langs = F.create_map(*[x for k, v in PROMPT_LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    lang_name = F.coalesce(F.try_element_at(langs, _c(language).cast("int")), F.lit(PROMPT_DEFAULT_LANGUAGE))
    bullets = F.array_join(F.transform(F.coalesce(_c(instructions), F.array().cast("array<string>")),
                                       lambda s: F.concat(F.lit("- "), s, F.lit("\n"))), "")
    class_lines = F.array_join(F.transform(
        _c(classes), lambda c: F.concat(F.lit("- ["), c["id"], F.lit("] "), c["class"], F.lit(": "),
                                        c["context"], F.lit("\n"))), "")
    has_classes = F.coalesce(F.size(_c(classes)), F.lit(0)) > 0
    tail = F.when(has_classes, F.concat(F.lit(PROMPT_CLASSES), class_lines, F.lit("\n"))).otherwise(F.lit("\n"))
    return F.concat(F.lit("You are "), _c(name), F.lit(", a "), F.lower(_c(adjective)), F.lit(" "),
                    _c(occupation), F.lit("."), F.lit(PROMPT_GOAL), _c(goal), F.lit(PROMPT_INSTRUCTIONS),
                    bullets, F.lit(PROMPT_LANGUAGE), lang_name,
                    F.lit(PROMPT_KNOWLEDGE), tail)


def knowledge_content(contents) -> Column:
    """H17 — chunk contents joined with the separator; empty -> fixed message."""
    joined = F.array_join(F.coalesce(_c(contents), F.array().cast("array<string>")), KNOWLEDGE_SEPARATOR)
    return F.when(joined == "", F.lit(KNOWLEDGE_EMPTY)).otherwise(joined)


def prompt_hash(prompt) -> Column:
    """H18 — first 12 hex digits of sha256(prompt)."""
    return F.substr(F.sha2(_c(prompt), 256), F.lit(1), F.lit(12))


def cache_key(record_id, model, p_hash) -> Column:
    """H18 — first 16 hex digits of sha256("id:model:prompt_hash")."""
    return F.substr(F.sha2(F.concat_ws(":", _c(record_id), _c(model), _c(p_hash)), 256), F.lit(1), F.lit(16))


def tool_arguments(raw) -> Column:
    """H19 — tool-call arguments as a JSON string: JSON of any kind stays, null or empty text is
    ``{}``, other text ``{"raw": text}``."""
    none = F.coalesce(_c(raw), F.lit("")) == ""
    return (F.when(none, F.lit("{}")).when(F.try_parse_json(_c(raw)).isNotNull(), _c(raw))
            .otherwise(F.to_json(F.struct(_c(raw).alias("raw")))))


def preview(text, n: int = 1000) -> Column:
    """H20 — request/response preview for logs (the first ``n`` characters)."""
    return F.substr(_c(text), F.lit(1), F.lit(n))


def join_instructions(instructions) -> Column:
    """H21 — expected-guidelines text."""
    return F.array_join(_c(instructions), "; ")


def judge_feedback(raw_string, raw_number=None, raw_bool=None) -> Column:
    """B16 — judge feedback to a score: 'yes'/'no' (trimmed, lower-cased) -> 1/0, any
    other string -> 0.0, a number -> double, a boolean -> 1/0, NULL stays NULL."""
    s = F.lower(F.trim(_c(raw_string)))
    from_str = F.when(s == "yes", F.lit(1.0)).when(s == "no", F.lit(0.0)).otherwise(F.lit(0.0))
    out = F.when(_c(raw_string).isNotNull(), from_str)
    if raw_number is not None:
        out = F.coalesce(out, _c(raw_number).cast("double"))
    if raw_bool is not None:
        out = F.coalesce(out, _c(raw_bool).cast("double"))
    return out


def groundedness(score) -> Column:
    """B17 — NULL -> 0.0, clamp to [0, 1], round 4."""
    return round_even(F.least(F.greatest(F.coalesce(_c(score).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 4)


def provider(model) -> Column:
    """B19 — provider of a model string: 'a/b' -> 'a', bare -> 'openai'."""
    m = _c(model)
    return F.when(F.instr(m, "/") > 0, F.substring_index(m, "/", 1)).otherwise(F.lit("openai"))


def judge_model_uri(model) -> Column:
    """B19 — judge URI: 'a/b' -> 'a:/b', bare -> 'openai:/b'."""
    m = _c(model)
    after = F.substr(m, F.instr(m, "/") + 1, F.length(m))
    return F.when(F.instr(m, "/") > 0, F.concat(provider(m), F.lit(":/"), after)).otherwise(
        F.concat(F.lit("openai:/"), m))
