"""Text expressions over descriptions, transcripts, names and model answers."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.functions import vocab
from dayweave.functions.numbers import bound


def trim_blank(x: Column) -> Column:
    return F.btrim(x, F.lit(vocab.BLANKS))


def capitalise(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def title_words(x: Column) -> Column:
    """``code-review`` to ``Code Review``."""
    return F.array_join(F.transform(F.split(x, "-"), capitalise), " ")


def truncate(x: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, ending in dots when cut."""
    clean = trim_blank(F.regexp_replace(x, "\n", " "))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))
    )


def _any_contains(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def activity_from_description(description: Column) -> Column:
    """Activity label of a free description; ``other`` when nothing is recognised."""
    text = trim_blank(F.lower(description))
    word = F.element_at(F.split(text, r"[\s,.]+"), 1)
    label = F.when(description.isNull() | (description == ""), F.lit("other"))
    for name, needles in vocab.DESCRIPTION_LABELS:
        label = label.when(text.rlike("|".join(needles)), F.lit(name))
    for name, words in vocab.FIRST_WORD_LABELS:
        label = label.when(word.isin(words), F.lit(name))
    return label.otherwise(F.lit("other"))


def _label_rules(pairs: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Neighbouring words of one label as one rule, in declared order."""
    return [(label, [word for word, _ in group]) for label, group in groupby(pairs, key=lambda p: p[1])]


def canonical_activity(activity: Column) -> Column:
    """Canonical activity label; unknown labels stay, with blanks turned into underscores."""
    lower = trim_blank(F.lower(activity))
    rules = _label_rules(vocab.ACTIVITY_SYNONYMS)
    label = F.when(lower.isNull(), F.lit(None).cast("string"))
    for name, words in rules:
        label = label.when(lower.isin(words), F.lit(name))
    for name, words in rules:
        label = label.when(lower.rlike("|".join(words)), F.lit(name))
    return label.otherwise(F.regexp_replace(lower, r"\s+", "_"))


def with_activity(df: DataFrame, alias: str = "activity") -> DataFrame:
    """Add the canonical activity: the stored one if there is any, else the one read from the description.

    The label is named in two steps so that its many uses do not copy the whole expression.
    """
    stored = F.when(F.col("activity_type") != "", F.col("activity_type"))
    raw = df.withColumn("_label", F.coalesce(stored, activity_from_description(F.col("vlm_description"))))
    return raw.withColumn(alias, canonical_activity(F.col("_label"))).drop("_label")


def clean_app(name: Column) -> Column:
    """Trimmed application name, null when it is noise."""
    text = trim_blank(name)
    bad = (F.length(text) < 2) | (F.length(text) > 50)
    for pattern in vocab.APP_NOISE_PATTERNS:
        bad = bad | text.rlike(pattern)
    return F.when(~bad, text)


def clean_topic(topic: Column) -> Column:
    text = trim_blank(topic)
    return F.when(F.length(text).between(2, 50), text)


def canonical_app(name: Column) -> Column:
    """Canonical application name through the alias list; unknown names are only trimmed."""
    key = trim_blank(F.regexp_replace(F.regexp_replace(F.lower(trim_blank(name)), r"[^a-z0-9\s]", ""), r"\s+", " "))
    rules = _label_rules(vocab.APP_ALIASES)

    def lookup(key: Column) -> Column:
        chain = F
        for canonical, aliases in rules:
            chain = chain.when(key.isin(aliases), F.lit(canonical))
        for canonical, aliases in rules:
            chain = chain.when(key.rlike("|".join(aliases)), F.lit(canonical))
        return chain.otherwise(trim_blank(name))

    return bound(key, lookup)


def is_noise_app(name: Column) -> Column:
    text = trim_blank(F.lower(name))
    return text.isin(vocab.APP_NOISE) | (F.length(text) < 2) | (F.length(text) > 50)


def name_similarity(a: Column, b: Column) -> Column:
    distance = F.levenshtein(F.lower(a), F.lower(b))
    return F.lit(1.0) - distance / F.greatest(F.length(a), F.length(b))


def canonical_apps(apps: Column) -> Column:
    """Canonical, de-duplicated and sorted names of one record.

    Names are taken shortest first; a name at least 85 % similar to an accepted one joins it.
    """
    ranked = F.array_sort(
        F.transform(apps, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x")))
    )
    names = F.transform(ranked, lambda r: canonical_app(r["x"]))
    names = F.filter(names, lambda x: ~is_noise_app(x))
    accepted = F.aggregate(
        names,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda known: name_similarity(x, known) >= 0.85), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_sort(accepted)


def is_personal_app(name: Column) -> Column:
    """True when the name contains one of the personal applications, in any case."""
    return trim_blank(F.lower(name)).rlike("|".join(a.lower() for a in vocab.PERSONAL_APPS))


def personal_share_flag(apps: Column) -> Column:
    """True when at least half of the distinct names are personal applications (exact names)."""
    names = F.array_distinct(apps)
    personal = F.size(F.array_intersect(names, F.array(*[F.lit(a) for a in vocab.PERSONAL_APPS])))
    return F.when(F.size(names) > 0, personal / F.size(names) >= 0.5).otherwise(F.lit(False))


def _hints(text: Column, patterns: list[str]) -> Column:
    found = F.array(*[F.regexp_extract(text, p, 1) for p in patterns])
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def app_hints(description: Column) -> Column:
    hits = _hints(F.lower(description), vocab.APP_HINTS)
    return F.array_distinct(F.transform(hits, lambda x: F.regexp_replace(x, "^([^ ]*) ", "$1_")))


def topic_hints(description: Column) -> Column:
    return _hints(F.lower(description), vocab.TOPIC_HINTS)


def urls(text: Column) -> Column:
    """Distinct sorted web addresses without trailing punctuation."""
    # Address characters and the punctuation cut from the end.
    found = F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s<>\"{}|\\^`\[\]]+)"), F.lit(1))
    cleaned = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))
    return F.array_sort(F.array_distinct(cleaned))


def media_indicators(text: Column) -> Column:
    """Media tags seen in the recognised text."""
    lower = F.lower(text)
    image = _any_contains(lower, [".png", ".jpg", ".jpeg", ".gif", ".webp"])
    return F.array_compact(
        F.array(
            F.when(lower.contains("youtube"), F.lit("youtube")),
            F.when(lower.contains("vimeo"), F.lit("vimeo")),
            F.when(lower.contains("netflix"), F.lit("netflix")),
            F.when(image, F.lit("image-file")),
        )
    )


def _may_loop(text: Column) -> Column:
    """False when a text cannot hold a unit of 20 characters repeated five times in a row.

    Such a stretch has no blank and 100 characters, or its words repeat in step, so that some three
    neighbouring words occur twice. The check is linear; the pattern itself is not.
    """

    def again(words: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))
        return F.when(F.size(words) >= 4, F.size(F.array_distinct(triples)) < F.size(words) - 2).otherwise(F.lit(False))

    return bound(F.split(text, " "), again) | text.rlike("[^ ]{100}")


def without_hallucinations(text: Column) -> Column:
    """Remove the first hit of every phrase a speech model invents, and one repetition loop."""
    *phrases, loop = vocab.HALLUCINATIONS
    for pattern in phrases:
        text = F.regexp_replace(text, rf"^([\s\S]*?){pattern}", "$1")
    shifted = loop.replace("\\1", "\\2")

    def unlooped(x: Column) -> Column:
        return F.when(_may_loop(x), F.regexp_replace(x, rf"^([\s\S]*?){shifted}", "$1")).otherwise(x)

    return trim_blank(bound(text, unlooped))


def strip_thinking(text: Column, keep: str = "last") -> Column:
    """Answer without reasoning tags.

    Text up to an unpaired closing tag is dropped: ``last`` keeps what follows the last such tag,
    ``second`` keeps the part between the first and the second.
    """
    paired = F.regexp_replace(text, r"<think>[\s\S]*?</think>", "")
    parts = F.split(paired, "</think>")
    position = F.lit(-1) if keep == "last" else F.when(F.size(parts) > 1, F.lit(2)).otherwise(F.lit(1))
    return trim_blank(F.element_at(parts, position))


def strip_reasoning_prose(text: Column, *, groups: bool = True) -> Column:
    """Drop ``Thinking Process:`` prose up to the next heading; nothing is left without a heading."""
    heading = r"#\s|\*\*|Group\s" if groups else r"#\s|\*\*"
    after = F.regexp_extract(text, r"(?:^|\n)Thinking Process:([\s\S]*)", 1)
    rest = F.regexp_extract(after, rf"\n((?:{heading})[\s\S]*)", 1)
    return F.when(text.rlike(r"(?:^|\n)Thinking Process:"), trim_blank(rest)).otherwise(text)


def comma_list(text: Column) -> Column:
    """``[a, b]`` or ``a, b`` to a list without blanks."""
    bare = trim_blank(F.regexp_replace(text, r"^\[|\]$", ""))
    return F.filter(F.transform(F.split(bare, ","), trim_blank), lambda x: x != "")


def json_or_comma_list(text: Column) -> Column:
    """A JSON array of strings, or the comma-joined text written by the recorder."""
    return F.coalesce(F.from_json(text, "array<string>"), F.when(~text.startswith("["), F.split(text, r",\s*")))


def session_id(raw: Column) -> Column:
    """Folder name to an id: blanks to dashes, brackets out, dashes collapsed, ``.cap`` cut."""
    x = F.regexp_replace(raw, r"\s+", "-")
    x = F.regexp_replace(x, r"[()\[\]{}]", "")
    x = F.regexp_replace(x, "—", "-")
    x = F.regexp_replace(x, "-+", "-")
    x = F.regexp_replace(x, "^-|-$", "")
    return F.regexp_replace(x, r"(?i)\.cap$", "")


def file_id(name: Column) -> Column:
    """File name to an id: extension cut, lower case, other characters to dashes, 100 characters."""
    x = F.regexp_replace(name, r"\.[^/.]+$", "")
    x = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, 100)


def content_hash(text: Column) -> Column:
    """Digest for change detection; only equality matters."""
    return F.md5(text)
