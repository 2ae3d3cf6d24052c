"""Keyword alerts of articles: rule groups, direction, severity, and suppression of copies.

An article's text is read once for all phrases together, in one scan without a join;
at most one alert for each group leaves it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.triggers import leading_edge

# Fixed values, down to RULE_KEYS: the built-in vocabulary, its categories and severities.
KEYWORDS = {
    "mna": ["acquisition", "acquires", "merger", "takeover", "buyout", "strategic review", "deal", "offer"],
    "financing": ["offering", "registered direct", "atm", "private placement", "convertible", "notes", "dilution", "shelf"],
    "earnings": ["earnings", "revenue", "eps", "guidance", "preliminary results", "raises outlook", "cuts outlook", "misses", "beats"],
    "legal_regulatory": ["sec", "doj", "ftc", "investigation", "subpoena", "lawsuit", "settlement", "fraud", "compliance"],
    "analyst": ["upgrade", "downgrade", "initiates", "price target", "overweight", "underweight", "buy rating", "sell rating"],
    "halt_risk": ["bankruptcy", "chapter 11", "delisting", "nasdaq notice", "going concern", "halted", "suspension"],
    "corporate_action": [
        "stock split", "reverse split", "special dividend", "spin-off", "spinoff", "tender offer", "buyback", "share repurchase",
        "rights offering", "dividend increase", "dividend cut",
    ],
}
CRITICAL = ["bankruptcy", "chapter 11", "delisting", "going concern", "halted", "suspension", "fraud"]
HIGH_GROUPS = ["mna", "earnings", "financing"]
MEDIUM_GROUPS = ["analyst", "corporate_action"]
BULLISH = [
    "beats", "raises outlook", "raises guidance", "upgrade", "overweight", "buy rating", "approval", "approved", "record revenue", "dividend increase",
    "buyback", "share repurchase", "wins", "awarded", "surges",
]
BEARISH = [
    "misses", "cuts outlook", "cuts guidance", "downgrade", "underweight", "sell rating", "investigation", "subpoena", "lawsuit", "fraud",
    "bankruptcy", "chapter 11", "delisting", "going concern", "dilution", "dividend cut", "recall", "plunges", "halted",
]
BREAKING = ["breaking", "alert:", "developing"]
DIGEST_MARKERS = ["breaking", "halted", "delisting", "bankruptcy", "alert:", "developing"]
SEVERITIES = ["low", "medium", "high", "critical"]
RULE_KEYS = ("phrases", "critical_phrases", "bullish", "bearish")


@dataclass
class Rules:
    """The vocabulary in force."""

    groups: dict[str, list[str]] = field(default_factory=lambda: {g: list(p) for g, p in KEYWORDS.items()})
    critical: list[str] = field(default_factory=lambda: list(CRITICAL))
    bullish: list[str] = field(default_factory=lambda: list(BULLISH))
    bearish: list[str] = field(default_factory=lambda: list(BEARISH))

    def extended(self, layer: dict[str, dict[str, list[str]]]) -> Rules:
        """These rules with the lists of ``layer`` added; a critical phrase is a phrase of its group too."""
        out = Rules({g: list(p) for g, p in self.groups.items()}, list(self.critical), list(self.bullish), list(self.bearish))
        for group, spec in layer.items():
            listed = out.groups.setdefault(group, [])
            for target, words in (
                (listed, spec.get("phrases", [])), (listed, spec.get("critical_phrases", [])), (out.critical, spec.get("critical_phrases", [])),
                (out.bullish, spec.get("bullish", [])), (out.bearish, spec.get("bearish", [])),
            ):
                target.extend(w for w in dict.fromkeys(words) if w not in target)
        return out


def read_overrides(path: str) -> dict[str, dict[str, list[str]]]:
    """Rule layers of a JSON file; anything that is not one gives none, unknown keys are passed over, words are lower-cased."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError):
        return {}
    return clean_overrides(raw) if isinstance(raw, dict) else {}


def clean_overrides(raw: dict) -> dict[str, dict[str, list[str]]]:
    specs = {str(g): s for g, s in raw.items() if isinstance(s, dict)}
    return {g: {k: [str(w).lower() for w in v if str(w).strip()] for k, v in s.items() if k in RULE_KEYS and isinstance(v, list)} for g, s in specs.items()}


def category(group: str) -> str:
    return f"{group}_keyword" if group in KEYWORDS else "custom_keyword"


def pattern(phrase: str) -> str:
    """A regular expression for the phrase; a word border only at an end that is a word character."""
    low = phrase.lower()
    border = lambda c: r"\b" if re.match(r"\w", c) else ""
    return border(low[0]) + r"\Q" + low + r"\E" + border(low[-1])


def _has(text: Column, phrase: str) -> Column:
    return F.contains(text, F.lit(phrase.lower())) & text.rlike(pattern(phrase))


def hits(text: Column, words: list[str]) -> Column:
    """The array of those ``words`` that stand in a lower-cased text, found in one pass.

    At each word border the longest word that starts there is taken; shorter ones that
    start at the same place are known from it beforehand. Words that start with
    another character are looked for one by one.
    """
    words = [w for w in dict.fromkeys(words) if w]
    plain = sorted((w for w in words if re.match(r"\w", w[0])), key=len, reverse=True)
    found = F.array().cast("array<string>")
    if plain:
        ends = "|".join(r"\Q" + w + r"\E" + (r"\b" if re.match(r"\w", w[-1]) else "") for w in plain)
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b(?=({ends}))"), F.lit(1)))
        inside = {w: [v for v in plain if v != w and re.match(re.escape(v) + (r"\b" if re.match(r"\w", v[-1]) else ""), w)] for w in plain}
        more = [F.when(F.array_contains(found, w), F.array(*map(F.lit, vs))) for w, vs in inside.items() if vs]
        for extra in more:
            found = F.array_union(found, F.coalesce(extra, F.array().cast("array<string>")))
    other = [w for w in words if w not in plain]
    if other:
        found = F.concat(found, F.array_compact(F.array(*(F.when(_has(text, w), F.lit(w)) for w in other))))
    return F.coalesce(found, F.array().cast("array<string>"))


def among(found: Column, words: list[str]) -> Column:
    return F.array_intersect(found, F.array(*map(F.lit, words)).cast("array<string>"))


def article_text() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("content_text", F.lit(""))))


def direction(found: Column, rules: Rules) -> Column:
    """Whether more bullish or more bearish terms were found."""
    lead = F.size(among(found, rules.bullish)) - F.size(among(found, rules.bearish))
    return F.when(lead > 0, "bullish").when(lead < 0, "bearish").otherwise("neutral")


def article_alerts(articles: DataFrame, rules: Rules = Rules(), interest: list[str] = (), latency_ms: int | None = 30_000) -> DataFrame:
    """Alerts of articles (``id``, ``headline``, ``summary``, ``content_text``, ``symbols``, ``received_us``, ``latest_us``, ``latency_ms``).

    Gives ``article_id``, ``category``, ``severity``, ``symbols``, ``matches``, ``direction``, ``reason``.
    Latency is receipt minus the newest content time, else the stored figure; None switches its alert off.
    """
    named = F.array_intersect(F.coalesce("symbols", F.array().cast("array<string>")), F.array(*map(F.lit, interest)).cast("array<string>"))
    vocabulary = [*(w for words in rules.groups.values() for w in words), *rules.bullish, *rules.bearish, *BREAKING]
    base = articles.select("id", "symbols", "received_us", "latest_us", "latency_ms", hits(article_text(), vocabulary).alias("_found"), named.alias("_hits"))
    found_words = F.col("_found")
    base = base.withColumn("_dir", direction(found_words, rules)).withColumns({f"_g{i}": among(found_words, words) for i, words in enumerate(rules.groups.values())})
    none = F.array().cast("array<string>")
    interested = F.size("_hits") > 0
    everyone = F.array_sort(F.array_distinct(F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(F.col("_hits"))))

    def alert(test: Column, name: str, severity: Column, symbols: Column, matches: Column, way: Column, why: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("category"), severity.alias("severity"), symbols.alias("symbols"), matches.alias("matches"), way.alias("direction"), why.alias("reason")))

    mention = F.concat(F.lit("article mentions interest symbol(s): "), F.array_join(F.array_sort("_hits"), ", "))
    found = [alert(interested, "held_or_interested_symbol", F.lit("high"), F.array_sort("_hits"), none, F.col("_dir"), mention)]
    custom_before = F.lit(False)
    for i, group in enumerate(rules.groups):
        words = F.col(f"_g{i}")
        worst = F.arrays_overlap(words, F.array(*map(F.lit, rules.critical)).cast("array<string>"))
        plain = "high" if group in HIGH_GROUPS else "medium" if group in MEDIUM_GROUPS or group not in KEYWORDS else "low"
        severity = F.when(worst, "critical").when(interested, "high").otherwise(plain)
        test = F.size(words) > 0
        if group not in KEYWORDS:  # one custom alert for an article: that of the first group
            test, custom_before = test & ~custom_before, custom_before | test
        why = F.concat(F.lit(f"keyword match in {group}: "), F.array_join(F.array_sort(words), ", "))
        found.append(alert(test, category(group), severity, everyone, F.array_sort(words), F.col("_dir"), why))
    tagged = F.size(among(found_words, BREAKING)) > 0
    found.append(alert(tagged, "breaking_keyword", F.when(interested, "high").otherwise("medium"), everyone, none, F.col("_dir"), F.lit("article tagged as breaking/developing")))
    if latency_ms is not None:
        late = F.coalesce(F.expr("(received_us - latest_us) div 1000"), F.col("latency_ms"))
        found.append(alert(late >= latency_ms, "high_latency", F.lit("medium"), F.array_sort("symbols"), none, F.lit("neutral"), F.concat(F.lit("latency_ms="), late.cast("string"), F.lit(f" exceeds threshold {latency_ms}"))))
    out = base.select(F.col("id").alias("article_id"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_a"))
    return out.select("article_id", "_a.*")


def without_copies(alerts: DataFrame, window_us: int = 86_400_000_000) -> DataFrame:
    """Alerts without those whose category and content another article's kept alert had within ``window_us``.

    Alerts (``article_id``, ``category``, ``content_hash``, ``created_us``) of one article and category fall together first.
    """
    once = alerts.groupBy("article_id", "category").agg(F.min_by(F.struct("content_hash", "created_us"), "created_us").alias("_a")).select("article_id", "category", "_a.*")
    keyed = once.filter(F.col("content_hash").isNotNull()).withColumn("_order", F.col("created_us"))
    kept = leading_edge(keyed, ["category", "content_hash"], "created_us", window_us + 1).drop("_order")
    return kept.unionByName(once.filter(F.col("content_hash").isNull()))


#: Fixed value: seconds in which a symbol's repeated alert of one category is held back.
MARKET_QUIET_SECONDS = 300


def _market_alert(category: Column, severity: Column, reason: Column, direction: Column) -> list[Column]:
    return ["symbol", "ts_us", category.alias("category"), severity.alias("severity"), F.array(F.upper("symbol")).alias("symbols"), reason.alias("reason"), direction.alias("direction")]


def _flagged(rows: DataFrame, important: DataFrame) -> DataFrame:
    return rows.join(important.select("symbol", F.lit(True).alias("_watched")).distinct(), "symbol", "left").withColumn("_watched", F.coalesce("_watched", F.lit(False)))


def status_alerts(statuses: DataFrame, important: DataFrame, background: bool = True) -> DataFrame:
    """Halts and resumptions among statuses (``symbol``, ``ts_us``, ``status_code``, ``status_msg``, ``reason_code``, ``reason_msg``).

    ``important`` lists watched symbols; others are background where the feed covers the whole market. Feeds may lack the reason.
    """
    for name in ("reason_code", "reason_msg"):
        if name not in statuses.columns:
            statuses = statuses.withColumn(name, F.lit(None).cast("string"))
    code, message = F.upper(F.coalesce("status_code", F.lit(""))), F.lower(F.coalesce("status_msg", F.lit("")))
    halt = (code == "H") | F.contains(message, F.lit("halt")) | F.contains(message, F.lit("pause"))
    resume = code.isin("T", "R") | F.contains(message, F.lit("resum")) | F.contains(message, F.lit("trading"))
    watched = F.col("_watched")
    severity = F.when(halt, F.when(watched, "critical").otherwise("low" if background else "high")).otherwise(F.when(watched, "medium").otherwise("low" if background else "medium"))
    text = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    detail = F.concat_ws("; ", text("status_msg"), F.coalesce(text("reason_msg"), text("reason_code")))
    reason = F.concat(F.upper("symbol"), F.lit(" trading status: "), F.when(detail != "", detail).otherwise(code))
    out = _flagged(statuses, important).select(*_market_alert(F.when(halt, "trading_halt").when(resume, "trading_resume"), severity, reason, F.lit("neutral")))
    return out.filter(F.col("category").isNotNull())


def band_alerts(bands: DataFrame) -> DataFrame:
    """An alert for each update of price bands (``symbol``, ``ts_us``, ``limit_up``, ``limit_down``, ``indicator``)."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    reason = F.concat(F.upper("symbol"), F.lit(" LULD band update: limit_up="), shown("limit_up"), F.lit(" limit_down="), shown("limit_down"), F.lit(" indicator="), shown("indicator"))
    return bands.select(*_market_alert(F.lit("luld"), F.lit("medium"), reason, F.lit("neutral")))


def trigger_alerts(triggers: DataFrame, important: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Alerts of price and volume triggers (``symbol``, ``ts``, ``category``, ``value``, ``direction``)."""
    name, value = F.upper("symbol"), F.col("value")
    reason = (
        F.when(F.col("category") == "price_move", F.concat(name, F.lit(" moved "), F.expr("format_number(value, '+0.00;-0.00')"), F.lit(f"% in ~{window_minutes} minutes")))
        .when(F.col("category") == "volume_spike", F.concat(name, F.lit(" minute volume "), F.expr("format_number(value, '0.0')"), F.lit("x its rolling average")))
        .otherwise(F.concat(name, F.lit(" broke its day "), F.when(F.col("direction") == "bullish", "high").otherwise("low"), F.lit(" ("), value.cast("string"), F.lit(")")))
    )
    rows = _flagged(triggers.withColumn("ts_us", F.col("ts") * 1_000_000), important)
    return rows.select(*_market_alert(F.col("category"), F.when(F.col("_watched"), "high").otherwise("medium"), reason, F.col("direction")))


def quieted(market_alerts: DataFrame, seconds: int = MARKET_QUIET_SECONDS) -> DataFrame:
    """Market alerts without repeats of a symbol and category within less than ``seconds`` of a kept one."""
    return leading_edge(market_alerts, ["symbol", "category"], "ts_us", seconds * 1_000_000)


def watched_story_alerts(states: DataFrame, watched: list[int], rules: Rules = Rules()) -> DataFrame:
    """An alert for every change of content (states after ``upsert.apply_updates``) of a watched article; ``article_id`` stays null, so none is held back as a repeat."""
    text = F.lower(F.concat_ws(" ", F.nullif("headline", F.lit("")), F.nullif("summary", F.lit(""))))
    rows = states.filter(F.col("id").isin(watched) & F.col("content_changed")).withColumn("_found", hits(text, [*rules.bullish, *rules.bearish]))
    return rows.select(
        F.lit(None).cast("long").alias("article_id"), F.lit("watched_story_update").alias("category"), F.lit("high").alias("severity"), F.array_sort(F.array_distinct("symbols")).alias("symbols"),
        "headline", F.concat(F.lit("watched story updated (article_id="), F.col("id").cast("string"), F.lit(", update #"), F.col("update_count").cast("string"), F.lit(")")).alias("reason"),
        direction(F.col("_found"), rules).alias("direction"), "received_at",
    )


def at_or_above(level: str) -> list[str]:
    """Severities from ``level`` upwards."""
    if level not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}")
    return SEVERITIES[SEVERITIES.index(level) :]
