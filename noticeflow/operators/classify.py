"""FLT, CLS, SCO: row-local gates, classes and scores, all as column expressions.

Rules are first match: branches stand in the order in which they win.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import dates, text as T
from noticeflow.functions.vocab import Layer, Vocabulary, best_group, first_group, keyword_share, layered_score, longest_term, matching_groups, word_terms

Branches = Sequence[tuple[Column, object]]


def first_match(branches: Branches, default: object = None) -> Column:
    """The value of the first condition that holds (null does not)."""
    out = F.lit(default)
    for condition, value in reversed(list(branches)):
        out = F.when(F.coalesce(condition, F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def by_table(key: Column, table: dict, default: object = None) -> Column:
    """CLS-20, OPP-12: value of key in a small table."""
    return first_match([(key == k, v) for k, v in table.items()], default)


def cut_offs(score: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """CLS-13, CLS-31, CLS-32: name of the first step that score reaches; steps from the top."""
    return first_match([(score >= least, name) for least, name in steps], below)


# --- gates -------------------------------------------------------------------------------------------------


def consulting_gate(title: Column, text: Column, override: Sequence[str], anchors: Sequence[str], soft: Sequence[str], kind: Column) -> Column:
    """FLT-05: struct(ok, reason): a row goes for an anchor in its title, for two soft signals there, or for one where the type is unknown.

    One of the override words anywhere in the text keeps it. All are parts of lower-case text; reason is null where the row stays.
    """
    head = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    anchor = F.coalesce(*[F.when(head.contains(a), a.strip()) for a in anchors], F.lit(None).cast("string"))
    some = F.filter(F.array(*[F.when(head.contains(w), w.strip()) for w in soft]).cast("array<string>"), lambda x: x.isNotNull())
    unknown = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("unknown")) == "unknown"
    reason = first_match([
        (T.has_part(text, override), F.lit(None).cast("string")),
        (anchor.isNotNull(), F.concat(F.lit("goods anchor in title: "), anchor)),
        (F.size(some) >= 2, F.concat(F.lit("several signals in title: "), F.array_join(F.slice(some, 1, 3), ", "))),
        ((F.size(some) == 1) & unknown, F.concat(F.lit("signal in title and unknown type: "), F.get(some, F.lit(0)))),
    ])
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def generic_only(text: Column, stop_words: Sequence[str], least: int = 4) -> Column:
    """FLT-07: no word that is long enough and no stop word."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.size(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop_words))) == 0


def quality_gate(text: Column, score: Column, threshold: float, whitelist: Sequence[str] = (), stop_words: Sequence[str] = T.STOP_WORDS, low: float = 40) -> Column:
    """FLT-06: why a row is rejected; null accepts it."""
    return first_match([(F.length(F.trim(F.coalesce(text, F.lit("")))) < 10, "too short"), (generic_only(text, stop_words), "generic"), (~T.has(text, whitelist, "part") & (score < low) if whitelist else F.lit(False), "no domain word"), (score < threshold, "low score")])


def reject_then_require(text: Column, reject: Sequence[str], require: Sequence[str], mode: str = "part") -> Column:
    """FLT-08, FLT-21 to FLT-25: no reject word, and a required one where there are any."""
    return ~T.has(text, reject, mode) & (T.has(text, require, mode) if require else F.lit(True))


def geographic(reference: Column, office: Column, title: Column, codes: Sequence[str], offices: Sequence[str], topics: Sequence[str]) -> Column:
    """FLT-09, FLT-23: a code in the reference, an office, or a topic in the title."""
    return T.any_of([T.has(reference, codes), T.has(office, offices, "part"), T.has(title, topics, "part")])


def skip_process(process: Column, skipped: Sequence[str]) -> Column:
    """FLT-10: whether a process type is one to notify about."""
    return ~T.has(process, skipped, "part")


def output_gate(decided: Column, expired: Column, noise: Column, routes: Sequence[Column]) -> Column:
    """FLT-11: a decision shows a row whatever else; else it is live, no noise, and a route lets it in."""
    return F.coalesce(decided, F.lit(False)) | (~F.coalesce(expired, F.lit(False)) & ~F.coalesce(noise, F.lit(False)) & T.any_of([F.coalesce(r, F.lit(False)) for r in routes]))


def low_confidence_rule(confidence: Column, is_new: Column, decided: Column, least: int = 40) -> Column:
    """FLT-12: low confidence stays only where a row is new or decided."""
    return (F.coalesce(confidence, F.lit(50)) >= least) | F.coalesce(is_new, F.lit(False)) | F.coalesce(decided, F.lit(False))


def boilerplate_markers(text: Column, markers: Sequence[str], within: int = 2500) -> Column:
    """FLT-14, FLT-15: how many markers the start of a page has."""
    return T.count_terms(F.substring(F.coalesce(text, F.lit("")), 1, within), markers, "part")


def low_value_page(text: Column, markers: Sequence[str], least: int = 200) -> Column:
    """FLT-15: two markers, or too short."""
    return (boilerplate_markers(text, markers) >= 2) | (F.length(F.coalesce(text, F.lit(""))) < least)


def useful_deep(source: Column, text: Column, markers: Sequence[str], least: int = 200) -> Column:
    """FLT-14: from a source, long enough, and less than two markers."""
    return T.clean_or_null(source).isNotNull() & ~low_value_page(text, markers, least)


def purge_bad(df: DataFrame, bad: Column, columns: Sequence[str]) -> DataFrame:
    """FLT-16: columns blanked where bad holds."""
    return df.withColumns({c: F.when(bad, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns})


def blocked_domain(url: Column, domains: Sequence[str]) -> Column:
    """FLT-17"""
    return T.any_of([F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).contains(d), F.lit(False)) for d in domains])


def early_project_gate(age_days: Column, strength: Column, infrastructure: Column, closes: Column, as_of: Column, oldest: int = 730, least: int = 10) -> Column:
    """FLT-18: why an early project is dropped; null keeps it. Count by reason for the drop counters."""
    return first_match([(age_days > oldest, "too old"), (strength < least, "weak signal"), (infrastructure & (strength < 2 * least), "infrastructure"), (closes < as_of, "window closed")])


def noise_source(source: Column, prefixes: Sequence[str], names: Sequence[str]) -> Column:
    """FLT-19"""
    s = F.lower(F.coalesce(source, F.lit("")))
    return T.any_of([s.startswith(p) for p in prefixes]) | s.isin(*names)


def reference_title(title: Column, pattern: str = r"(?i)^\s*(?:ref|rfp|rfq|tender|notice)?[\s.:#]*[A-Z0-9]+(?:[/\-][A-Z0-9]+)+\s*$") -> Column:
    """FLT-20: a title that is a reference number only."""
    return F.coalesce(title, F.lit("")).rlike(pattern)


# --- classes ----------------------------------------------------------------------------------------------


def organisation(field: Column, source: Column, text: Column, by_source: dict[str, str], rules: Sequence[tuple[str, str]]) -> Column:
    """CLS-05: the field, else the source's, else by words in the text, else a ministry it names."""
    ministry = F.nullif(F.initcap(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b((?:ministry|department) of [a-z]+(?: [a-z]+)?)", 1)), F.lit(""))
    return F.coalesce(T.clean_or_null(field), by_table(source, by_source), first_match([(T.has(text, [w]), name) for w, name in rules]), ministry)


def structured(df: DataFrame, as_of: Column, sectors: Vocabulary, types: Vocabulary, regions: Vocabulary, layers: Sequence[Layer], divisor: float = 160, blocked: Sequence[str] = ()) -> DataFrame:
    """CLS-07, SUB-11: classes and relevance of records (tender_id, title, description, deadline); rows without an id go."""
    blob = T.search_blob("title", "description")
    rows = df.where(T.clean_or_null("tender_id").isNotNull()).withColumn("text_lc", blob)
    block = T.has("text_lc", blocked) if blocked else None
    return rows.select(
        *df.columns,
        best_group("text_lc", sectors, "General").alias("sector"),
        best_group("text_lc", types, "Unknown").alias("consulting_type"),
        longest_term("text_lc", regions, "Global").alias("region"),
        dates.deadline_bucket("deadline", as_of).alias("deadline_category"),
        layered_score(F.col("text_lc"), layers, divisor, block).alias("relevance_score"),
    )


def signals(text: Column, families: dict[str, Vocabulary]) -> Column:
    """CLS-08: struct of the first matching group of each family."""
    return F.struct(*[first_group(text, v).alias(name) for name, v in families.items()])


def amount(raw: Column) -> Column:
    """CLS-09: an amount with k, m, million, lakh or crore; null where there is none."""
    t = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), ",", "")
    number = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(t, r"\d\s*(million|mn|m|billion|bn|thousand|k|lakh|crore)\b", 1)
    factor = by_table(unit, {"million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "crore": 1e7}, 1.0)
    return number * factor


def contract_size(raw: Column, text: Column, large: Sequence[str], small: Sequence[str], million: float = 1e6) -> Column:
    """CLS-09: by amount, else by words."""
    a = amount(raw)
    return first_match([(a >= million, "large"), (a >= million / 10, "medium"), (a.isNotNull(), "small"), (T.has(text, large), "large"), (T.has(text, small), "small")], "unknown")


def notice_type(text: Column, consulting: Sequence[str], goods: Sequence[str]) -> Column:
    """CLS-10"""
    return first_match([(T.has(text, consulting), "consulting"), (T.has(text, goods), "goods")], "unknown")


def consulting_ratio(code: Column, text: Column, codes: dict[str, float], phrases: dict[str, float], extra: Sequence[str], default: float = 0.4) -> Column:
    """CLS-11: of an exact code, else a phrase, else default; 0.05 more a hit, 0.20 at most; 1 at most."""
    base = F.coalesce(by_table(F.lower(code), codes), first_match([(T.has(text, [p]), v) for p, v in phrases.items()]), F.lit(default))
    return F.least(F.lit(1.0), base + F.least(F.lit(0.2), T.count_terms(text, extra) * 0.05))


def completeness_score(text: Column, method: Column, amount_: Column, deadline: Column, words: Sequence[str]) -> Column:
    """CLS-12: words 30, hits 25, method 20, amount 15, deadline 10."""
    return F.least(F.lit(30), T.words_in(text)) + F.least(F.lit(25), T.count_terms(text, words) * 5) + method.isNotNull().cast("int") * 20 + amount_.isNotNull().cast("int") * 15 + deadline.isNotNull().cast("int") * 10


def decision_tier(score: Column, confidence: Column, top: float = 75, top_confidence: float = 0.70, strong: float = 60, weak: float = 40, ignore: float = 0.40) -> Column:
    """CLS-13: BID_NOW, STRONG_CONSIDER, WEAK_CONSIDER or IGNORE."""
    return first_match([(confidence < ignore, "IGNORE"), ((score >= top) & (confidence >= top_confidence), "BID_NOW"), (score >= strong, "STRONG_CONSIDER"), (score >= weak, "WEAK_CONSIDER")], "IGNORE")


def batch_filter(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CLS-14: accepted rows, rejected rows, and counts by reason."""
    marked = df.withColumn("reject_reason", reason)
    rejected = marked.where("reject_reason IS NOT NULL")
    return marked.where("reject_reason IS NULL").drop("reject_reason"), rejected, rejected.groupBy("reject_reason").count()


def boosted(score: Column, boosts: Sequence[tuple[Column, float]]) -> Column:
    """CLS-15, CLS-17: score with what holds added, from 0 to 100."""
    return T.clamp(sum((F.coalesce(c.cast("int"), F.lit(0)) * v for c, v in boosts), score))


def group_capped(text: Column, v: Vocabulary, days: Column, urgent: int = 7, bonus: float = 5) -> Column:
    """CLS-16: a group's weight once, and a bonus for what is urgent."""
    total = sum((T.has(text, g.terms, g.mode).cast("int") * F.lit(float(g.weight)) for g in v.groups), F.lit(0.0))
    return T.clamp(total + F.coalesce(days.between(0, urgent).cast("int"), F.lit(0)) * bonus)


def evidence_state(page_chars: Column, n_links: Column, n_extracted: Column, has_scope: Column, least: int = 400) -> Column:
    """CLS-18: full_scope, partial_scope, document_pending or title_only."""
    return first_match([((n_extracted > 0) & has_scope, "full_scope"), ((page_chars >= least) | (n_extracted > 0), "partial_scope"), (n_links > 0, "document_pending")], "title_only")


# Characters from which a text counts, and the states.
SCOPE_CHARS, SUMMARY_CHARS, PAGE_CHARS, CRITERIA_CHARS, FILE_CHARS = 100, 50, 180, 80, 200
PACKAGE_STATES = ("SIGNAL_ONLY", "PAGE_ONLY", "PARTIAL_PACKAGE", "FULL_PACKAGE")


def evidence_package(df: DataFrame, url_pattern: str, hint_pattern: str, name: str = "evidence") -> DataFrame:
    """CLS-18 over texts and links: df with a struct(state, n_urls): what there is of a record beyond its title.

    df: deep_scope, deep_description, deep_pdf_text, summary, eval_criteria, cross_sources, description (texts) and links, an array of struct(url, label, file_type, extracted,
    char_count). Rich: a text that is long enough, or a file that was read. Signals: a link, a URL of url_pattern in the texts, or a word of
    hint_pattern in texts or links. Both with a file's text, or with a scope and more: the full package.
    """
    texts = ("deep_scope", "deep_description", "deep_pdf_text", "summary", "eval_criteria", "cross_sources", "description")
    clean = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in texts}
    links = F.coalesce(F.col("links"), F.from_json(F.lit("[]"), df.schema["links"].dataType))
    said = F.array_join(F.transform(links, lambda x: F.concat_ws(" ", x["url"], x["label"], x["file_type"])), "\n")
    out = df.withColumns({"_blob": F.concat_ws(" ", *clean.values()), "_said": said, "_links": links})
    found = lambda c, p: F.regexp_extract_all(F.col(c), F.lit(f"({p})"), F.lit(1))
    given = F.filter(F.transform("_links", lambda x: F.trim(F.coalesce(x["url"], F.lit("")))), lambda u: u != "")
    out = out.withColumn("_urls", F.array_distinct(F.concat(given, found("_blob", url_pattern)))).withColumn("_hints", F.size(found("_blob", hint_pattern)) + F.size(found("_said", hint_pattern)))
    long = lambda c, n: F.length(clean[c]) >= n
    chars = F.aggregate("_links", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["char_count"].cast("long"), F.lit(0)))
    scope, summary = long("deep_scope", SCOPE_CHARS), long("summary", SUMMARY_CHARS)
    page = long("deep_description", PAGE_CHARS) | long("description", PAGE_CHARS) | long("eval_criteria", CRITERIA_CHARS)
    file = long("deep_pdf_text", FILE_CHARS) | (chars >= FILE_CHARS) | F.exists("_links", lambda x: F.coalesce(x["extracted"], F.lit(False)))
    signals = (F.size("_urls") > 0) | (F.col("_hints") > 0)
    rich = scope | summary | page | file
    nothing, only_page, partial, full = PACKAGE_STATES
    state = first_match([(~rich & ~signals, nothing), (~signals, only_page), (file | (scope & (summary | page)), full)], partial)
    return out.withColumn(name, F.struct(state.alias("state"), F.when(signals, F.size("_urls")).otherwise(0).alias("n_urls"))).drop("_blob", "_said", "_links", "_urls", "_hints")


def evidence_features(links: Column, text: Column, hints: Sequence[str]) -> Column:
    """CLS-19, SUB-25: links, distinct URLs, extracted ones, their characters and hint hits."""
    empty = F.array().cast("array<struct<url:string,label:string,file_type:string,extracted:boolean,char_count:int>>")
    x = F.coalesce(links, empty)
    return F.struct(F.size(x).alias("n_links"), F.size(F.array_distinct(F.transform(x, lambda i: F.lower(i["url"])))).alias("n_urls"), F.size(F.filter(x, lambda i: i["extracted"])).alias("n_extracted"), F.aggregate(x, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(i["char_count"], F.lit(0))).alias("n_chars"), T.count_terms(text, hints, "part").alias("n_hints"))


#: CLS-20: what each evidence state means and asks for.
MATURITY = {"full_scope": ("Full scope", "score and decide"), "partial_scope": ("Partial scope", "read the notice"), "document_pending": ("Documents pending", "fetch documents"), "title_only": ("Title only", "wait for detail")}


def maturity(state: Column) -> Column:
    return F.struct(by_table(state, {k: v[0] for k, v in MATURITY.items()}).alias("label"), by_table(state, {k: v[1] for k, v in MATURITY.items()}).alias("action"))


def fit_signals(relevance: Column, complexity: Column, days: Column) -> Column:
    """CLS-21: technical fit and feasibility of delivery."""
    fit = cut_offs(relevance, [(70, "high"), (45, "medium")], "low")
    feasible = first_match([(days < 5, "low"), ((complexity >= 70) & (days < 15), "low"), (complexity >= 50, "medium")], "high")
    return F.struct(fit.alias("technical_fit"), feasible.alias("feasibility"))


def suggested_label(priority: Column, relevance: Column, expired: Column, goods: Column) -> Column:
    """CLS-22: one of three labels."""
    return first_match([(expired, "Not Relevant"), (goods & (relevance < 50), "Not Relevant"), ((priority >= 70) & (relevance >= 50), "Relevant"), ((priority >= 45) | (relevance >= 55), "Maybe")], "Not Relevant")


def label_status(old: Column, new: Column) -> Column:
    """CLS-23: new, carried, updated or unlabelled."""
    return first_match([(new.isNull() & old.isNull(), "unlabelled"), (old.isNull(), "new"), (new.isNull() | (new == old), "carried")], "updated")


def insight(sector: Column, kind: Column, bucket: Column, priority: Column) -> Column:
    """CLS-24, TXT-03: one sentence on what it is, a second from priority 40 on."""
    lead = F.concat(F.initcap(F.coalesce(kind, F.lit("notice"))), F.lit(" in "), F.coalesce(sector, F.lit("an unnamed sector")), F.lit("."))
    more = F.when(priority >= 40, by_table(bucket, {"closing_soon": "It closes within a week.", "needs_action": "It needs action within three weeks.", "plan_ahead": "There is time to prepare."}, "Its deadline is unknown."))
    return F.concat_ws(" ", lead, more)


def why(*parts: Column) -> Column:
    return F.concat_ws(" + ", *parts)


def query_type(query: Column, families: Vocabulary, default: str = "general") -> Column:
    """CLS-25, CLS-26: the first family of words that occurs; off-topic is one of them."""
    return first_group(query, families, default)


def signal_tier(text: Column, positive: Vocabulary, negative: Vocabulary) -> Column:
    """CLS-27, DOC-14: struct(labels, tier, change of confidence)."""
    good, bad = matching_groups(text, positive), matching_groups(text, negative)
    net = F.size(good) - F.size(bad)
    return F.struct(F.array_union(good, bad).alias("labels"), first_match([(net >= 3, "strong"), (net >= 1, "moderate"), (F.size(good) > 0, "weak")], "none").alias("tier"), (net * 5).alias("change"))


def signal_stage(days_to_tender: Column, confidence: Column) -> Column:
    """CLS-28: struct(stage, action)."""
    stage = first_match([(days_to_tender <= 90, "near"), (days_to_tender <= 365, "pre")], "early")
    action = first_match([((stage == "near") & (confidence >= 60), "prepare bid"), (confidence >= 60, "build relations"), (confidence >= 40, "monitor")], "watch")
    return F.struct(stage.alias("stage"), action.alias("action"))


def project_stage(status: Column, approved: Column, as_of: Column, words: dict[str, str], recent: int = 365) -> Column:
    """CLS-29: by the status, else by how recent approval is."""
    return F.coalesce(first_match([(F.lower(status).contains(w), s) for w, s in words.items()]), first_match([(approved.isNull(), "unknown"), (F.datediff(as_of, approved) <= recent, "recent")], "mature"))


def recommendation(fit: Column, priority: Column) -> Column:
    """CLS-30: bid, consider or skip by the mean of fit and priority, with confidence."""
    mean = 0.5 * fit + 0.5 * priority
    return F.struct(cut_offs(mean, [(70, "bid"), (45, "consider")], "skip").alias("decision"), T.clamp(T.half_even(F.abs(mean - 57.5) * 2)).cast("int").alias("confidence"))


# --- scores -------------------------------------------------------------------------------------------------


def blended_fit(semantic: Column, keyword: Column, weight: float = 0.70) -> Column:
    """SCO-04, SCO-05: similarity (from 0 to 1) as points, and keywords."""
    return T.clamp(T.half_even(weight * T.clamp(semantic * 115) + (1 - weight) * keyword)).cast("int")


def red_flags(text: Column | T.Hits, value: Column, deadline: Column, as_of: Column, goods: Sequence[str], ineligible: Sequence[str], most: float = 5e6) -> Column:
    """SCO-06: names of what speaks against a record."""
    flags = [(T.has(text, goods), "goods only"), (value > most, "too large"), (dates.is_expired(deadline, as_of), "EXPIRED"), (T.has(text, ineligible), "ineligible")]
    return F.filter(F.array(*[F.when(c, n) for c, n in flags]), lambda x: x.isNotNull())


def process_batch(df: DataFrame, keywords: Vocabulary, goods: Sequence[str], ineligible: Sequence[str], as_of: Column, high_value: Sequence[str] = (), rich: Sequence[str] = (), most: float = 5e6) -> DataFrame:
    """SCO-03 to SCO-06 together: one row for each row of df with a title, with fit_score, red_flags, top_reasons and tender_id; best fit first, then by id.

    df: title, url, source, description, deadline (date), value, similarity (0 to 1, null counts as 0), tender_id. Texts of the columns in rich, where they come to
    more than 100 characters, take the description's place. A row without an id gets one from its URL.
    """
    deep = F.concat_ws("\n\n", *[F.nullif(F.trim(c), F.lit("")) for c in rich]) if rich else F.lit("")
    body = F.when(F.length(deep) > 100, deep).otherwise(F.coalesce("description", F.lit("")))
    out = df.where(F.trim("title") != "").withColumn("_text", F.concat_ws(" ", F.trim("title"), body))
    out, h = T.with_hits(out, "_text", [*word_terms(keywords), *goods, *ineligible])
    fit = blended_fit(F.coalesce("similarity", F.lit(0.0)), keyword_share(h, keywords, high_value))
    made = {"tender_id": F.coalesce(T.clean_or_null("tender_id"), F.left(F.md5(F.coalesce("url", F.lit(""))), F.lit(16))), "fit_score": fit, "red_flags": red_flags(h, F.col("value"), F.col("deadline"), as_of, goods, ineligible, most), "top_reasons": F.slice(matching_groups(h, keywords), 1, 5)}
    return out.withColumns(made).drop("_text", "_words").orderBy(F.desc("fit_score"), "tender_id")


def confidence_score(base: Column, shallow: Column, deep: Column, negative: Column) -> Column:
    """OPP-01: a type's base; 4 a shallow hit up to 18, 3 a deep one up to 12, less 6 a negative one up to 30."""
    return T.clamp(T.half_even(base + F.least(F.lit(18), shallow * 4) + F.least(F.lit(12), deep * 3) - F.least(F.lit(30), negative * 6))).cast("int")


def service_fit(base: Column, confidence: Column) -> Column:
    """OPP-02"""
    return T.half_even(0.8 * base + 0.2 * confidence).cast("int")


def procurement_penalty(n: Column, confidence: Column) -> Column:
    """OPP-04: 6 a hit up to 28, 4 more where confidence is below 45."""
    return F.least(F.lit(28), n * 6) + F.when(confidence < 45, 4).otherwise(0)


def capability(service: Column, sector: Column, client: Column) -> Column:
    """OPP-05: points of three matches, each none, partial or full."""
    points = lambda c, part, full: by_table(c, {"partial": part, "full": full}, 0)
    return points(service, 3, 5) + points(sector, 2, 4) + points(client, 3, 8)


def priority(model: Column, portfolio: Column, keyword: Column, adjustments: Column, expired: Column, divisor: float = 1.2) -> Column:
    """The weighted sum of OPP-06 with adjustments made elsewhere, over divisor; 0 where expired. opportunity.score has the whole of it."""
    return F.when(F.coalesce(expired, F.lit(False)), 0).otherwise(T.clamp(T.half_even((0.5 * model + 0.3 * portfolio + 0.2 * keyword + adjustments) / divisor))).cast("int")


def competition(tier: Column, text: Column | T.Hits, high: Sequence[str]) -> Column:
    """OPP-07"""
    return first_match([(tier == "top", "high"), (tier == "known", "medium"), (T.has(text, high), "medium")], "low")


def opportunity_size(text: Column | T.Hits, large: Sequence[str], small: Sequence[str]) -> Column:
    """OPP-08"""
    a, b = T.count_terms(text, large), T.count_terms(text, small)
    return first_match([(a > b, "large"), (b > a, "small")], "medium")


def complexity(text: Column | T.Hits, requirements: Sequence[str], scope: Sequence[str]) -> Column:
    """OPP-09: length / 100 to 40, 3 a requirement word to 30, 5 a scope word to 30."""
    return (F.least(F.lit(40), F.floor(F.length(T.col(text)) / 100)) + F.least(F.lit(30), T.count_terms(text, requirements) * 3) + F.least(F.lit(30), T.count_terms(text, scope) * 5)).cast("int")


def rerank_boost(similarities: Column, most: float = 6.0) -> Column:
    """OPP-13: mean of the three best similarities, up to so many points."""
    top = F.slice(F.reverse(F.array_sort(similarities)), 1, 3)
    return F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top) * most).otherwise(0.0)


def signal_strength(text: Column, weights: Sequence[tuple[str, int]], infrastructure: Sequence[str], cap: int = 40) -> Column:
    """EPS-02: struct(score, matched): terms in order until the cap is reached; 5 less for two infrastructure words."""
    each = F.filter(F.array(*[F.when(T.has(text, [w], "part"), F.struct(F.lit(w).alias("w"), F.lit(p).alias("p"))) for w, p in weights]), lambda x: x.isNotNull())
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<string>").alias("m"))
    run = F.aggregate(each, start, lambda a, x: F.when(a["s"] >= cap, a).otherwise(F.struct((a["s"] + x["p"]).alias("s"), F.array_append(a["m"], x["w"]).alias("m"))))
    less = F.when(T.count_terms(text, infrastructure, "part") >= 2, 5).otherwise(0)
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(cap), run["s"]) - less).alias("score"), run["m"].alias("matched"))


def early_score(recency: Column, sector: Column, geography: Column, strength: Column) -> Column:
    """EPS-03"""
    return F.least(F.lit(100), recency + sector + geography + strength)


def firm_fit(text: Column, boosts: Vocabulary, penalties: Vocabulary, worst: float = -30) -> Column:
    """EPS-04: boosts, and penalties down to a floor, with the first two reasons."""
    from noticeflow.functions.vocab import weighted_sum

    minus = F.greatest(F.lit(float(worst)), weighted_sum(text, penalties, per_group=True))
    return F.struct(T.clamp(weighted_sum(text, boosts, per_group=True) + minus).alias("score"), F.slice(matching_groups(text, boosts), 1, 2).alias("reasons"))


def scoring_note(**parts: Column) -> Column:
    """OPP-11: name=value of parts that there are."""
    return F.concat_ws("; ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in parts.items()])


def data_confidence(success_rate: Column, words: Column, deadline: Column, organisation_: Column, sector: Column) -> Column:
    """CNF-01: source's success rate x 0.4, words 20 or 10, deadline 20, organisation 10, sector 10."""
    w = first_match([(words >= 100, 20), (words >= 30, 10)], 0)
    return T.clamp(T.half_even(F.coalesce(success_rate, F.lit(70.0)) * 0.4 + w + deadline.isNotNull().cast("int") * 20 + T.clean_or_null(organisation_).isNotNull().cast("int") * 10 + T.clean_or_null(sector).isNotNull().cast("int") * 10)).cast("int")


def schema_violations(df: DataFrame, expected: dict[str, str], required: Sequence[str] = ()) -> DataFrame:
    """DQ-01, DQ-02: share of rows of which a field can't be read as its type, or a required one is missing; over all rows."""
    wrong = [F.avg((F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t}) IS NULL")).cast("double")).alias(c) for c, t in expected.items()]
    absent = [F.avg(T.clean_or_null(c).isNull().cast("double")).alias(f"{c}_missing") for c in required]
    return df.agg(*wrong, *absent)


