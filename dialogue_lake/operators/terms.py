"""Terminology: spans of text, glossary variants, exact and fuzzy candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogue_lake.functions import fixed_values as fixed
from dialogue_lake.functions import text as tx
from dialogue_lake.functions.similarity import indel_ratio, lexical_score, metaphone
from dialogue_lake.operators import similar
from dialogue_lake.operators.intervals import range_join
from dialogue_lake.operators.lookup import counted_join, spread_join
from dialogue_lake.session import stored

FENCE = "\u0001"
SPAN_KEY = ["meeting_id", "utt_idx", "char_start", "char_end"]


@dataclass(frozen=True)
class RetrievalRules:
    top_k: int = 5
    min_score: float = 0.64
    lexical_floor: float = 0.78
    phonetic_floor: float = 0.88
    context_floor: float = 0.30
    lexical_weight: float = 0.45
    phonetic_weight: float = 0.25
    semantic_weight: float = 0.25
    scope_weight: float = 0.05


def token_offsets(utterances: DataFrame, pattern: str, number: str) -> DataFrame:
    """Every match of a one-group pattern with its character offsets, numbered per text."""
    parts = F.split(F.regexp_replace("text", pattern, f"{FENCE}$1{FENCE}"), FENCE, -1)
    # One partition is one utterance, a single cell of the input table.
    upto = Window.partitionBy("meeting_id", "utt_idx").orderBy("_i")
    return (
        utterances.select("meeting_id", "utt_idx", F.posexplode(parts).alias("_i", "token"))
        .withColumn("char_end", F.sum(F.length("token")).over(upto))
        .filter(F.col("_i") % 2 == 1)
        .select(
            "meeting_id", "utt_idx", F.floor(F.col("_i") / 2).cast("bigint").alias(number), "token",
            (F.col("char_end") - F.length("token")).alias("char_start"), "char_end")
    )


def ngram_spans(utterances: DataFrame, longest: int = 4) -> DataFrame:
    """Every run of one to ``longest`` tokens with its offsets and observed text.

    A token carries the text up to the next one, so a run is put together from its own
    window and the whole text is not looked at again.
    """
    parts = F.split(F.regexp_replace("text", tx.TERM_TOKEN, f"{FENCE}$1{FENCE}"), FENCE, -1)
    # Odd parts are tokens, even ones what stands before, between and after them.
    pieces = F.transform(F.sequence(F.lit(0), (F.size("_parts") / 2).cast("int")), lambda i: F.struct(
        F.get("_parts", 2 * i - 1).alias("token"), F.get("_parts", 2 * i).alias("gap")))
    cut = utterances.select("meeting_id", "utt_idx", parts.alias("_parts")).select("meeting_id", "utt_idx", F.posexplode(pieces).alias("_i", "_p"))
    # One partition is one utterance, a single cell of the input table.
    within = Window.partitionBy("meeting_id", "utt_idx").orderBy("_i")
    length = F.coalesce(F.length("_p.token"), F.lit(0)) + F.length("_p.gap")
    ahead = F.collect_list(F.struct("_p.token", "_p.gap", "char_start", "char_end")).over(within.rowsBetween(0, longest - 1))
    placed = cut.withColumn("_upto", F.sum(length).over(within)).select(
        "meeting_id", "utt_idx", "_i", "_p", (F.col("_upto") - length).alias("char_start"),
        (F.col("_upto") - F.length("_p.gap")).alias("char_end"))
    tokens = placed.filter(F.col("_i") > 0).withColumn("_run", ahead)
    spans = tokens.select("meeting_id", "utt_idx", (F.col("_i") - 1).cast("bigint").alias("token_no"), "char_start", "_run", F.posexplode(
        F.transform("_run", lambda x: x["char_end"])).alias("_n", "char_end"))
    texts = F.transform(F.slice("_run", F.lit(1), F.col("_n")), lambda x: F.concat(x["token"], x["gap"]))
    return spans.select(
        *SPAN_KEY[:2], "token_no", (F.col("_n") + 1).cast("bigint").alias("n_tokens"), "char_start", "char_end",
        F.concat(F.array_join(texts, ""), F.element_at("_run", F.col("_n") + 1)["token"]).alias("observed"))


def spans_to_words(spans: DataFrame, utterances: DataFrame) -> DataFrame:
    """Words a character span touches: first and last index, times when given."""
    words = token_offsets(utterances, r"(\S+)", "word_index").select(
        "meeting_id", "utt_idx", "word_index", F.col("char_start").alias("_ws"), F.col("char_end").alias("_we"))
    met = range_join(
        spans.select(*SPAN_KEY), words, ["meeting_id", "utt_idx"],
        (F.col("char_start"), F.col("char_end")), (F.col("_ws"), F.col("_we")),
        (F.col("_ws") < F.col("char_end")) & (F.col("_we") > F.col("char_start")), width=256)
    return met.groupBy(*SPAN_KEY).agg(
        F.min("word_index").alias("first_word"), F.max("word_index").alias("last_word"))


def normal_forms(spans: DataFrame) -> DataFrame:
    """(observed, normalized, compact): each distinct observed form that can be a term, once.

    The distinct forms are stored, or else the filters would run before them, on every span.
    """
    return (
        stored(spans.select("observed").distinct())
        .withColumn("normalized", tx.normalize_term(F.col("observed")))
        .filter(
            (F.col("normalized") != "")
            & ~tx.is_protected(F.col("observed"))
            & ~F.col("normalized").isin(fixed.STOP_TERMS))
        .withColumn("compact", F.replace("normalized", F.lit(" "), F.lit("")))
    )


def variant_table(glossary: DataFrame) -> DataFrame:
    """One row per registered form: canonical first, then aliases, then ASR aliases.

    ``glossary`` has array columns ``aliases`` and ``asr_aliases``.
    """
    forms = F.concat(
        F.array(F.struct(F.lit("canonical_exact").alias("kind"), F.col("canonical").alias("variant"))),
        F.transform("aliases", lambda a: F.struct(F.lit("alias_exact").alias("kind"), a.alias("variant"))),
        F.transform("asr_aliases", lambda a: F.struct(F.lit("asr_alias_exact").alias("kind"), a.alias("variant"))),
    )
    rest = [c for c in glossary.columns if c not in ("aliases", "asr_aliases")]
    return glossary.select(*rest, F.posexplode(forms).alias("form_no", "_f")).select(
        *rest, F.col("form_no").cast("bigint").alias("form_no"), "_f.kind", "_f.variant"
    ).withColumn("variant_normalized", tx.normalize_term(F.col("variant"))).withColumn(
        "variant_compact", F.replace("variant_normalized", F.lit(" "), F.lit("")))


def scope_score(scope: Column, priority: Column) -> Column:
    base = F.when(scope == "global", 0.2).when(scope == "project", 0.6).otherwise(1.0)
    return 0.8 * base + 0.2 * priority


def exact_candidates(spans: DataFrame, variants: DataFrame) -> DataFrame:
    """Spans whose compact form equals a registered form's.

    Distinct observed forms meet the registered ones first, and only those that equal one
    meet the spans. The kind of the form is kept only where the raw texts are equal as well.
    Every plain letter or digit stays in the compact form, so a span that has more of them
    than any registered form has characters is not normalised at all.
    """
    longest = variants.agg(F.max(F.length("variant_compact")).alias("_longest"))
    letters = F.length(F.regexp_replace("observed", "[^A-Za-z0-9]+", ""))
    short = spans.join(F.broadcast(longest), (F.length("observed") <= F.col("_longest")) | (letters <= F.col("_longest")))
    forms = normal_forms(short).hint("merge")
    found = stored(forms.join(variants.withColumnRenamed("variant_compact", "compact"), "compact"))
    joined = counted_join(spans, found, ["observed"], F.struct("meeting_id", "utt_idx", "char_start"))
    return joined.withColumn(
        "match_type", F.when(F.col("observed") == F.col("variant"), F.col("kind")).otherwise("normalized_exact"))


def close_forms(distinct_spans: DataFrame, variants: DataFrame, rules=RetrievalRules()) -> DataFrame:
    """(normalized, variant_normalized, lexical, phonetic) of all pairs above either floor.

    Spelling and sound each have an index of their own: texts on the characters of the text,
    distinct codes on those of the code. Only pairs that an index proposes are compared.
    """
    texts = stored(distinct_spans.select("normalized").distinct())
    forms = stored(variants.select("variant_normalized").distinct().filter(F.col("variant_normalized") != ""))
    # Sorting tokens keeps the characters, so neither ratio of the lexical score is above
    # that of the bags, and the bags must reach the floor itself.
    spelt = similar.candidates(texts, forms, rules.lexical_floor)
    # Codes are made once per text and stored; the joins below read them several times.
    coded = lambda df, text, code: stored(df.withColumn(code, metaphone(F.replace(text, F.lit(" "), F.lit("")))))
    own, other = coded(texts, "normalized", "_x"), coded(forms, "variant_normalized", "_y")
    sounding = similar.candidates(own.select("_x").distinct(), other.select("_y").distinct(), rules.phonetic_floor)
    sounding = stored(sounding.withColumn("phonetic", indel_ratio("_x", "_y")).filter(F.col("phonetic") >= rules.phonetic_floor - 1e-9))
    alike = own.join(sounding.select("_x", "_y"), "_x").join(other, "_y").select("normalized", "variant_normalized")
    pairs = spelt.withColumn("_alike", F.lit(False)).unionByName(alike.withColumn("_alike", F.lit(True))).groupBy(
        "normalized", "variant_normalized").agg(F.max("_alike").alias("_alike"))
    scored = stored(pairs.withColumn("lexical", lexical_score("normalized", "variant_normalized")).filter(
        F.col("_alike") | (F.col("lexical") >= rules.lexical_floor)).drop("_alike"))
    return scored.join(own, "normalized").join(other, "variant_normalized").select(
        "normalized", "variant_normalized", "lexical",
        F.when(F.col("_x") == "", 0.0).otherwise(indel_ratio("_x", "_y")).alias("phonetic"))


def form_candidates(forms: DataFrame, variants: DataFrame, rules=RetrievalRules()) -> DataFrame:
    """Shortlist per distinct form: close forms for ordinary ones, equal forms for digits and short ones.

    ``forms`` carry ``observed``, ``normalized`` and ``compact``. Registered forms that merely
    contain the observed one are dropped, since they would add words nobody said.
    """
    strict = F.col("normalized").rlike(r"\p{N}") | (F.length("compact") <= 2)
    free = forms.filter(~strict)
    pairs = close_forms(free.select("normalized").distinct(), variants, rules)
    fuzzy = free.join(pairs, "normalized").join(variants, "variant_normalized")
    x, y = metaphone("compact"), metaphone("variant_compact")
    equal = forms.filter(strict).join(variants.withColumn("compact", F.col("variant_compact")), "compact").withColumns({
        "lexical": lexical_score("normalized", "variant_normalized"), "_x": x, "_y": y}).withColumn(
        "phonetic", F.when(F.col("_x") == "", 0.0).otherwise(indel_ratio("_x", "_y"))).drop("_x", "_y")
    exact = F.col("compact") == F.col("variant_compact")
    return fuzzy.unionByName(equal).withColumn("is_exact", exact).filter(
        F.col("is_exact") | ~F.contains(F.col("variant_compact"), F.col("compact")))


def candidate_pairs(spans: DataFrame, variants: DataFrame, rules=RetrievalRules()) -> DataFrame:
    """Spans with the registered forms that are close to them.

    Everything up to the scores happens once per distinct observed form. Only forms with a
    candidate meet the spans, so what is kept grows with the terms found, not with the text.
    """
    forms = stored(normal_forms(spans))
    found = stored(form_candidates(forms, variants, rules))
    return counted_join(spans, found, ["observed"], F.struct("meeting_id", "utt_idx", "char_start"))


def context_cosine(pairs: DataFrame, contexts: DataFrame, entry_vectors: DataFrame) -> DataFrame:
    """Cosine in [0, 1] of utterance context and entry, for short-listed pairs only."""
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    wanted = pairs.select("meeting_id", "utt_idx", "entry_id").distinct()
    with_context = wanted.join(contexts.withColumnRenamed("vector", "_u"), ["meeting_id", "utt_idx"])
    with_both = spread_join(
        with_context, entry_vectors.select("entry_id", F.col("vector").alias("_e")), ["entry_id"],
        F.struct("meeting_id", "utt_idx"), "inner")
    cosine = dot(F.col("_u"), F.col("_e")) / F.sqrt(dot(F.col("_u"), F.col("_u")) * dot(F.col("_e"), F.col("_e")))
    return with_both.select(
        "meeting_id", "utt_idx", "entry_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)).alias("semantic"))


def score_candidates(pairs: DataFrame, semantic: DataFrame, rules=RetrievalRules()) -> DataFrame:
    """Gate and score the shortlist; best form per entry, the first form on a tie."""
    rows = pairs.join(semantic, ["meeting_id", "utt_idx", "entry_id"])
    gate = F.col("semantic") >= rules.context_floor
    scope = scope_score(F.col("scope"), F.col("priority"))
    weighted = (
        rules.lexical_weight * F.col("lexical") + rules.phonetic_weight * F.col("phonetic")
        + rules.semantic_weight * F.col("semantic") + rules.scope_weight * scope)
    raised = F.greatest(weighted, 0.90 + 0.05 * F.col("semantic") + 0.05 * scope)
    requires = F.col("requires_context") if "requires_context" in pairs.columns else F.lit(False)
    scored = (
        rows.filter((F.col("is_exact") | gate) & (~requires | gate))
        .withColumn("scope_score", scope)
        .withColumn("_raw", F.when(F.col("is_exact"), raised).otherwise(weighted))
        .filter(F.col("is_exact") | (F.col("_raw") >= rules.min_score))
        .withColumn("score", F.least(F.lit(1.0), "_raw"))
        .withColumn(
            "match_type",
            F.when(F.col("observed") == F.col("variant"), F.col("kind"))
            .when(F.col("is_exact"), "normalized_exact").otherwise("fuzzy"))
    )
    best = F.struct(
        (-F.col("score")).alias("_o"), "form_no", "canonical", "scope", "variant", "match_type", "score", "lexical",
        "phonetic", "semantic", "scope_score")
    return scored.groupBy(*SPAN_KEY, "observed", "normalized", "entry_id").agg(F.min(best).alias("_b")).select(
        *SPAN_KEY, "observed", "normalized", "entry_id", "_b.canonical", "_b.scope", "_b.variant", "_b.match_type",
        "_b.score", "_b.lexical", "_b.phonetic", "_b.semantic", "_b.scope_score")


def top_candidates(candidates: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` by score, scope and id; the rank limit is the feature."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("scope_score"), "entry_id")
    return candidates.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def choose_spans(proposals: DataFrame) -> DataFrame:
    """Greedy choice of spans without overlap, per utterance.

    ``proposals`` hold the best candidate of each span with ``match_type, score, entry_id,
    first_word, last_word``. Exact before fuzzy, then score, length, place, id; a span is
    taken when neither its characters nor its words meet a taken one. The fold runs over
    the proposals of one utterance.
    """
    proposal = F.struct(
        (F.col("match_type") == "fuzzy").alias("fuzzy"), (-F.col("score")).alias("s"),
        (F.col("char_start") - F.col("char_end")).alias("l"), F.col("char_start").alias("char_start"),
        F.col("entry_id").alias("entry_id"), F.col("char_end").alias("char_end"),
        F.col("first_word").alias("first_word"), F.col("last_word").alias("last_word"))
    grouped = proposals.groupBy("meeting_id", "utt_idx").agg(F.array_sort(F.collect_list(proposal)).alias("_p"))
    kept = F.aggregate(
        "_p", F.slice("_p", 1, 0),
        lambda taken, p: F.when(
            F.exists(taken, lambda t: ((p["char_start"] < t["char_end"]) & (p["char_end"] > t["char_start"]))
                     | ((p["first_word"] <= t["last_word"]) & (p["last_word"] >= t["first_word"]))),
            taken).otherwise(F.concat(taken, F.array(p))))
    return grouped.select("meeting_id", "utt_idx", F.explode(kept).alias("_k")).select(
        "meeting_id", "utt_idx", "_k.char_start", "_k.char_end", "_k.entry_id", "_k.first_word", "_k.last_word")


def glossary_violations(entries: DataFrame) -> DataFrame:
    """Rules a glossary must keep, one row per broken rule.

    ``entries``: ``entry_id, canonical, category, scope, sense, variants, ambiguous``.
    """
    row = lambda df, rule: df.select("entry_id", F.lit(rule).alias("rule"))
    doubled = entries.groupBy("entry_id").count().filter(F.col("count") > 1)
    bad_category = entries.filter(~F.col("category").rlike("^[a-z][a-z0-9_]{0,80}$"))
    named = entries.withColumn("_key", tx.normalize_term(F.col("canonical")))
    senses = named.groupBy("scope", "_key").agg(
        F.count(F.lit(1)).alias("n"), F.count("sense").alias("with_sense"), F.count_distinct("sense").alias("senses"))
    unclear = senses.filter((F.col("n") > 1) & ((F.col("with_sense") < F.col("n")) | (F.col("senses") < F.col("n"))))
    same_name = named.join(unclear, ["scope", "_key"], "left_semi")
    forms = lambda column: entries.select("entry_id", "scope", F.explode(column).alias("_form")).select(
        "entry_id", "scope", tx.compact_key(F.col("_form")).alias("_key"))
    keyed = forms("variants")
    empty = keyed.filter(F.col("_key") == "")
    marks = forms("ambiguous").distinct().withColumn("_said", F.lit(True))
    marked = keyed.join(marks, ["entry_id", "scope", "_key"], "left").withColumn("_marked", F.coalesce("_said", F.lit(False)))
    clash = marked.groupBy("scope", "_key").agg(
        F.count_distinct("entry_id").alias("n"), F.bool_and("_marked").alias("all_marked")
    ).filter((F.col("n") > 1) & ~F.col("all_marked"))
    colliding = marked.join(clash, ["scope", "_key"], "left_semi")
    return (
        row(doubled, "duplicate_id").unionByName(row(bad_category, "bad_category"))
        .unionByName(row(same_name, "duplicate_canonical_without_sense"))
        .unionByName(row(empty, "empty_variant")).unionByName(row(colliding, "unmarked_collision")).distinct())


def suspicious_spans(candidates: DataFrame, supplied: DataFrame, use_global: bool = False, floor: float = 0.70) -> DataFrame:
    """Records whose wording resembles a supplied term without being it.

    ``candidates`` hold one row per (record, candidate); ``supplied`` the entry ids the
    meeting's own context names.
    """
    observed, canonical = F.col("observed"), F.col("canonical")
    marked = spread_join(
        candidates, supplied.select("meeting_id", "entry_id").distinct().withColumn("_supplied", F.lit(True)),
        ["meeting_id", "entry_id"], F.struct("utt_idx", "char_start")
    ).withColumn("supplied", F.coalesce("_supplied", F.lit(False)))
    marked = marked.withColumns({
        "_o": tx.comparable(observed), "_c": tx.comparable(canonical),
        "_os": F.size(tx.protected_signature(observed)) > 0, "_cs": F.size(tx.protected_signature(canonical)) > 0,
        "_stop": F.arrays_overlap(F.split("normalized", " "), F.array(*[F.lit(s) for s in fixed.STOP_TERMS])),
    })
    explicit = F.col("match_type") == "asr_alias_exact"
    phonetic = F.col("phonetic") >= 0.88
    lexical = F.col("lexical") >= F.when(F.col("supplied"), 0.70).otherwise(0.78)
    inflected = F.lit(False)
    for suffix in ("s", "es"):
        inflected = inflected | (F.col("_o") == F.concat("_c", F.lit(suffix))) | (F.col("_c") == F.concat("_o", F.lit(suffix)))
    shouted = (F.upper(F.trim(observed)) == F.trim(observed)) & (F.lower(observed) != observed)
    usable = (
        (F.col("supplied") | F.lit(use_global)) & ~F.col("_cs") & (F.col("match_type") != "alias_exact")
        & ~inflected & (explicit | ~F.col("_stop")) & ~shouted & (explicit | (phonetic & lexical)))
    raw = F.col("score") + F.when(F.col("supplied"), 0.10).otherwise(0.0) + F.when(explicit, 0.05).otherwise(0.0)
    priority = F.least(F.lit(1.0), raw)
    signals = F.array_compact(F.array(
        F.when(F.col("supplied"), "supplied_context"), F.when(phonetic, "phonetic_match"),
        F.when(lexical, "lexical_match"), F.when(explicit, "registered_asr_alias")))
    ready = marked.withColumns({"_use": usable, "priority": priority, "signals": signals})
    return (
        ready.groupBy(*SPAN_KEY)
        .agg(
            F.bool_or(F.col("_o") == F.col("_c")).alias("_correct"),
            F.bool_or(F.col("_os") | F.lower(observed).isin(fixed.STOP_TERMS)).alias("_barred"),
            F.max(F.when(F.col("_use") & (F.col("priority") >= floor), F.struct("priority", "signals"))).alias("_best"))
        .filter(~F.col("_correct") & ~F.col("_barred") & F.col("_best").isNotNull())
        .select(*SPAN_KEY, "_best.priority", "_best.signals"))


def window_vocabulary(candidates: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """Terms offered for one window: supplied first, then scope, score, id; one per name."""
    named = candidates.withColumn("_key", tx.normalize_term(F.col("canonical")))
    best = F.struct(
        (~F.col("supplied")).alias("a"), (-F.col("scope_score")).alias("b"), (-F.col("score")).alias("c"),
        F.col("entry_id").alias("entry_id"), F.col("canonical").alias("canonical"))
    one = named.groupBy(*keys, "_key").agg(F.min(best).alias("_b"))
    order = Window.partitionBy(*keys).orderBy("_b")
    return (
        one.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
        .select(*keys, "rank", "_b.entry_id", "_b.canonical"))


def pack_vocabulary(terms: DataFrame, keys: list[str], limit: int = 223, prefix: str = "Possible vocabulary: ") -> DataFrame:
    """Names in rank order as long as the prompt stays within ``limit`` bytes of UTF-8.

    A name that does not fit is left out and later ones are still tried. A window has a
    handful of ranked names.
    """
    grouped = terms.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), lambda t: t["canonical"]).alias("_names"))

    def add(names: Column, name: Column) -> Column:
        longer = F.concat(names, F.array(name))
        size = F.octet_length(F.concat(F.lit(prefix), F.array_join(longer, ", "), F.lit(".")))
        return F.when(size > limit, names).otherwise(longer)

    packed = F.aggregate("_names", F.array().cast("array<string>"), add)
    return grouped.select(
        *keys, F.size(packed).cast("bigint").alias("kept"),
        F.when(F.size(packed) > 0, F.concat(F.lit(prefix), F.array_join(packed, ", "), F.lit("."))).otherwise("").alias("prompt"))


def extract_terms(documents: DataFrame, known: DataFrame, cap: int = 256) -> DataFrame:
    """Known names and identifiers of each text, first form per normalised name.

    ``documents``: ``source_id, text``; ``known``: ``canonical``. Known names come first.
    Tokens are joined with the names, so no text is compared with every name. Every term
    has its ``rank`` in the text; ``within_budget`` marks the first ``cap``.
    """
    folded = lambda c: F.lower(c)
    tokens = documents.select(
        "source_id", F.explode(F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("_t"))
    names = known.select("canonical", F.element_at(
        F.regexp_extract_all(folded(F.col("canonical")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), 1).alias("_t")).distinct()
    maybe = spread_join(tokens, names, ["_t"], F.col("source_id"), "inner").select("source_id", "canonical").distinct()
    found = maybe.join(documents, "source_id").filter(tx.count_term(F.col("text"), F.col("canonical")) > 0).select(
        "source_id", F.lit(0).alias("_group"), F.lit(0).cast("int").alias("_pos"), F.col("canonical").alias("term"))
    shaped = documents.select("source_id", F.posexplode(tx.identifier_terms(F.col("text"))).alias("_pos", "term")).select(
        "source_id", F.lit(1).alias("_group"), "_pos", "term")
    first = (
        found.unionByName(shaped).withColumn("term_key", tx.normalize_term(F.col("term")))
        .groupBy("source_id", "term_key").agg(F.min(F.struct("_group", "_pos", "term")).alias("_f")))
    order = Window.partitionBy("source_id").orderBy("_f")
    return first.withColumn("rank", F.row_number().over(order).cast("bigint")).select(
        "source_id", "term_key", "_f.term", "rank", (F.col("rank") <= cap).alias("within_budget"))


def merge_context_terms(terms: DataFrame, cap: int = 256) -> DataFrame:
    """Explicit and inferred terms merged per (meeting, scope, name), explicit first.

    ``terms``: ``meeting_id, scope, canonical, aliases, source_id, priority, inferred,
    order_no``. More than ``cap`` terms in a meeting is flagged, not cut.
    """
    keyed = terms.withColumn("term_key", tx.normalize_term(F.col("canonical")))
    key = ["meeting_id", "scope", "term_key"]
    merged = keyed.groupBy(*key).agg(
        F.min_by("canonical", F.struct("inferred", "order_no")).alias("canonical"),
        F.max("priority").alias("priority"), F.bool_and("inferred").alias("inferred"))

    def distinct(rows: DataFrame, name: str, first: Column) -> DataFrame:
        """Distinct values of a term in order of first mention; only these are ever collected."""
        values = rows.groupBy(*key, name).agg(F.min(first).alias("_first"))
        return values.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_first", name))).alias("_l")).select(
            *key, F.transform("_l", lambda x: x[name]).alias(f"{name}s"))

    aliases = distinct(keyed.select(*key, "order_no", F.posexplode("aliases").alias("_p", "alias")), "alias", F.struct("order_no", "_p")).withColumnRenamed("aliass", "aliases")
    sources = distinct(keyed, "source_id", F.col("order_no"))
    rows = merged.join(aliases, key, "left").join(sources, key)
    return rows.select(
        *key, "canonical", "priority", "inferred", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "source_ids",
        F.concat(F.lit("context."), F.substring(F.sha2(F.concat("scope", F.lit(":"), "term_key"), 256), 1, 20)).alias("entry_id"))


def override_layers(layers: list[DataFrame], key: str = "entry_id") -> DataFrame:
    """Union of layers; a later layer replaces an entry of the same id."""
    stacked = None
    for rank, layer in enumerate(layers):
        part = layer.withColumn("_layer", F.lit(-rank))
        stacked = part if stacked is None else stacked.unionByName(part)
    columns = [c for c in stacked.columns if c != "_layer"]
    return stacked.groupBy(key).agg(F.min_by(F.struct(*columns), "_layer").alias("_row")).select("_row.*")


def attach_sources(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the context sources of an entry to a candidate's reasons."""
    notes = sources.select(
        "entry_id", F.transform("source_ids", lambda s: F.concat(F.lit("context_source:"), s)).alias("_notes"))
    joined = spread_join(candidates, notes, ["entry_id"], F.struct("meeting_id", "utt_idx"))
    return joined.withColumn(
        "reasons", F.concat("reasons", F.coalesce("_notes", F.array().cast("array<string>")))).drop("_notes")


def dedup_lines(lines: DataFrame) -> DataFrame:
    """Glossary lines kept once per name, first domain first, with a stable id."""
    return lines.groupBy("name_key").agg(F.min(F.struct("domain", "line")).alias("_f")).select(
        "name_key", "_f.domain", "_f.line",
        F.concat(F.lit("global."), F.substring(F.sha2("name_key", 256), 1, 20)).alias("entry_id"))


def glossary_stats(glossary: DataFrame) -> DataFrame:
    """Entry counts by category and scope, with alias totals."""
    return glossary.groupBy("category", "scope").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.size("aliases") + F.size("asr_aliases")).alias("aliases"))
