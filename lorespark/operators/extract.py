"""Entities, events, relations, claims and places from passages, by rules that are data.

Every record points at the exact span that supports it. First-wins merges have explicit emission orders, names
meet text by equi-joins on tokens, and no regex is made per row.

documents: document_id, source_id, title, source_url; passages: passage_id, document_id, passage_index, text.
Null texts and names give nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..session import checkpointed
from .lookup import held_names


@dataclass(frozen=True)
class Rules:
    """Fixed values by default: patterns, lexicons and confidences."""

    word_types: tuple[tuple[str, str], ...] = (
        (r"\bhotel\b", "hotel"),
        (r"\bmarket\b", "market"),
        (r"\b(?:railway )?station\b", "railway_station"),
        (r"\b(?:church|cathedral)\b", "church"),
        (r"\btheatre\b", "theatre"),
        (r"\b(?:public record office|heritage database)\b", "government_institution"),
    )
    suffix_types: tuple[tuple[str, str], ...] = (
        ("market", "market"), ("station", "railway_station"), ("railway station", "railway_station"), ("hotel", "hotel"), ("church", "church"), ("cathedral", "church"), ("theatre", "theatre"), ("gaol", "landmark"),
        ("jail", "landmark"), ("bridge", "landmark"), ("street", "street"), ("road", "street"), ("square", "landmark"), ("building", "building"), ("hall", "building"), ("museum", "organisation"),
        ("council", "government_institution"), ("government", "government_institution"), ("authority", "government_institution"), ("office", "government_institution"), ("university", "organisation"), ("festival", "organisation"),
    )
    suburbs: tuple[str, ...] = ("Carlton", "Collingwood", "Fitzroy", "Richmond", "North Melbourne", "Port Melbourne")
    places: tuple[str, ...] = ("Melbourne", "Victoria")
    forenames: tuple[str, ...] = ("john", "james", "william", "charles", "robert", "francis", "joseph", "edward")
    name_pattern: str = (
        r"\b(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ&'’-]*[ \t]+){0,5}(?:Railway Station|Market|Station|Hotel|Church|Cathedral|Theatre|Gaol|Jail|Bridge|"
        r"Street|Road|Square|Building|Hall|Museum|Council|Government|Authority|Office|University|Festival)\b"
    )
    bare_names: tuple[str, ...] = (
        "bridge", "building", "cathedral", "church", "government", "hall", "hotel", "market", "museum", "office", "road", "square", "station", "street", "theatre", "town hall", "university",
    )
    vague_names: tuple[str, ...] = ("bridge", "building", "church", "hotel", "market", "station", "town hall")
    leading: str = r"^(?:Former|New|Old|Other|Several|Many|Some|This|That)\b"
    alias: str = r"(?i)(?:also known as|formerly known as)\s+([^,.;()]{2,80})"
    events: tuple[tuple[str, str, str], ...] = (
        ("demolition", r"\b(?:demolish(?:ed|ion)|razed|torn down)\b", "was_demolished"),
        ("construction", r"\b(?:built|constructed|completed|erected)\b", "was_constructed"),
        ("opening", r"\b(?:opened|opening|inaugurated)\b", "opened"),
        ("closure", r"\b(?:closed|closure|ceased operations?)\b", "closed"),
        ("renaming", r"\b(?:renamed|became known as|name changed)\b", "was_renamed"),
        ("renovation", r"\b(?:renovated|restored|refurbished|redeveloped)\b", "was_renovated"),
        ("relocation", r"\b(?:relocated|moved to)\b", "was_relocated"),
        ("fire", r"\b(?:fire|burned|burnt down)\b", "experienced_fire"),
        ("heritage_listing", r"\b(?:heritage list(?:ed|ing)|listed on the|heritage register)\b", "was_heritage_listed"),
        ("redevelopment", r"\b(?:redevelopment|replaced by)\b", "was_redeveloped"),
    )
    veto: str = r"(?i)\b(?:proposed|planned|intended|would be|was to begin|failed to|never|not completed|not constructed|not built)\b"
    inverted: str = r"(?i)^(?:Built|Constructed|Completed|Opened|Demolished|Renovated|Restored|Redeveloped)\b"
    dates: str = (
        r"(?i)\b(?:(?:early|mid|late)[ -](?:eighteenth|nineteenth|twentieth|twenty-first) century|(?:early|mid|late)[ -](?:1[0-9]{3}|20[0-2][0-9])s|(?:1[0-9]{3}|20[0-2][0-9])s)\b"
        r"|\b(?:c\.?\s*|circa\s+|around\s+)?(?:1[0-9]{3}|20[0-2][0-9])\b"
    )
    relations: tuple[tuple[str, str, str, str], ...] = (
        ("DESIGNED_BY", r"\bdesigned by\s+", r"(?:(?:the|an?)\s+)?(?:(?:English|local|railways?)\s+)?(?:(?:architects?|architectural practice|office of)\s+)?", "person"),
        ("OPERATED_BY", r"\boperated by\s+(?:the\s+)?", "", "organisation"),
        ("RENAMED_TO", r"\brenamed (?:as|to)\s+", "", "building"),
        ("REPLACED_BY", r"\breplaced by\s+", "", "building"),
    )
    proper: str = r"([A-Z][A-Za-z&'’.-]*(?:(?:[ \t]+(?:and|of|the)[ \t]+|[ \t]+|,\s*)[A-Z][A-Za-z&'’.-]*){0,6})"
    firm: str = r"(?:,|\band\b|\bDepartment\b|\bPartners\b|\bArchitects\b)"
    locative: str = r"(?i)^[^.]{0,160}\b(?:located|situated|stands?|lies?|based)\b[^.]*"
    disputed: str = r"(?i)\b(?:disputed|sources? (?:differ|disagree)|variously reported|uncertain)\b"
    address: str = r"(?im)^\|?\s*Location\s*\|\s*([^|\n]+)"
    coordinates: str = r"(?<!\d)(-3[6-8]\.\d{3,8})\s*[;,]\s*(14[3-6]\.\d{3,8})(?!\d)"


SPECIFIC_NOT = ("place", "suburb", "street", "government_institution")
FALLBACK_NOT = (*SPECIFIC_NOT, "person", "organisation")


def _any_word(words: tuple[str, ...]) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


def entity_type(name: Column, title: Column | None = None, rules: Rules = Rules()) -> Column:
    """The first rule that applies: a word in the name, the longest suffix, a lexicon, the title, else building."""
    low = T.casefold(name)
    found = [(low.rlike(p), kind) for p, kind in rules.word_types]
    # The leftmost match that reaches the end is the longest suffix.
    suffix = F.regexp_extract(low, f"({'|'.join(s for s, _ in rules.suffix_types)})$", 1)
    kinds = F.create_map(*[F.lit(x) for pair in rules.suffix_types for x in pair])
    found += [(suffix != "", kinds[suffix])]
    found += [(low.rlike(_any_word(rules.suburbs)), "suburb"), (low.isin(*[p.lower() for p in rules.places]), "place"), (low.rlike(_any_word(rules.forenames)), "person")]
    if title is not None:
        found.append((T.casefold(title).contains("architecture"), "landmark"))
    out = F.lit("building")
    for when, kind in reversed(found):
        out = F.when(when, kind if isinstance(kind, Column) else F.lit(kind)).otherwise(out)
    return out


def primary_name(title: Column, rules: Rules = Rules()) -> Column:
    name = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    topic = F.regexp_extract(name, r"(?i)^(?:History|Architecture) of (.+)$", 1)
    name = F.when(topic != "", topic).otherwise(name)
    return F.regexp_replace(name, rf"(?i),\s*(?:{'|'.join(rules.places)})$", "")


def entities(documents: DataFrame, passages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """entity_id, canonical_name, entity_type, aliases, supporting_passage_ids, confidence, extraction_method."""
    first = passages.groupBy("document_id").agg(F.min_by("passage_id", "passage_index").alias("passage_id"))
    named = documents.join(first, "document_id").withColumn("_name", primary_name(F.col("title"), rules))
    order = lambda late, index, emitter, at: F.struct(F.col("document_id"), F.lit(late).alias("late"), index.alias("index"), F.lit(emitter).alias("emitter"), at.alias("at"))
    zero = F.lit(0)
    titles = named.select(F.col("_name").alias("raw"), entity_type(F.col("_name"), F.col("title"), rules).alias("entity_type"), "passage_id", F.lit("document_title_rule_v1").alias("method"), F.lit(0.98).alias("confidence"), order(0, zero, 0, zero).alias("o"))
    hits = passages.select("document_id", "passage_id", "passage_index", F.posexplode(F.regexp_extract_all("text", F.lit(rules.name_pattern), F.lit(0))).alias("at", "hit"))
    suffixed = hits.withColumn("raw", T.clean_name("hit")).select("raw", entity_type(F.col("raw"), None, rules).alias("entity_type"), "passage_id", F.lit("named_suffix_rule_v1").alias("method"), F.lit(0.88).alias("confidence"), order(1, F.col("passage_index"), 1, F.col("at")).alias("o"))
    lexicon = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(p).alias("name"), F.lit("place" if p in rules.places else "suburb").alias("kind"), F.col("text").rlike(rf"\b{p}\b").alias("there")) for k, p in enumerate((*rules.places, *rules.suburbs))])
    placed = passages.select("document_id", "passage_id", "passage_index", F.explode(F.filter(lexicon, lambda x: x["there"])).alias("p")).select(
        F.col("p.name").alias("raw"), F.col("p.kind").alias("entity_type"), "passage_id", F.lit("place_lexicon_v1").alias("method"), F.lit(0.92).alias("confidence"), order(1, F.col("passage_index"), 2, F.col("p.at")).alias("o")
    )
    return _merged(titles.unionByName(suffixed).unionByName(placed), _aliases(named, passages, rules), rules)


def _aliases(named: DataFrame, passages: DataFrame, rules: Rules) -> DataFrame:
    """key, entity_type, alias: what the first two passages of a document call its title; the last document wins."""
    lead = passages.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("passage_index"))).filter("_n <= 2")
    lead = lead.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), " ").alias("lead"))
    rows = named.join(lead, "document_id").select("document_id", T.normalise_key(T.clean_name("_name")).alias("key"), entity_type(F.col("_name"), F.col("title"), rules).alias("entity_type"), F.col("_name"), T.clean_name(F.regexp_extract("lead", rules.alias, 1)).alias("alias"))
    return rows.filter((F.col("alias") != "") & (T.casefold("alias") != T.casefold("_name"))).groupBy("key", "entity_type").agg(F.max_by("alias", "document_id").alias("alias"))


def _merged(candidates: DataFrame, aliases: DataFrame | None, rules: Rules) -> DataFrame:
    rows = candidates.withColumn("name", T.clean_name("raw")).withColumn("key", T.normalise_key("name"))
    rows = rows.filter((F.length("name") >= 3) & (T.word_count("name") <= 8) & ~F.col("key").isin(*rules.bare_names) & ~F.col("name").rlike(rules.leading) & (F.col("key") != ""))
    out = rows.groupBy("key", "entity_type").agg(F.min_by(F.struct("name", "method"), "o").alias("f"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("passage_id")).alias("supporting_passage_ids"))
    alias = F.array().cast("array<string>")
    if aliases is not None:
        out = out.join(aliases, ["key", "entity_type"], "left")
        alias = F.array_compact(F.array("alias"))
    return out.select(T.stable_id("ent", "entity_type", "f.name").alias("entity_id"), F.col("f.name").alias("canonical_name"), "entity_type", alias.alias("aliases"), "supporting_passage_ids", "confidence", F.col("f.method").alias("extraction_method"))


def _padded(c: Column | str) -> Column:
    """Lower case with every other mark than word characters as a space, a space more at both ends: offsets stay."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", " "), F.lit(" "))


def _last_start(sentence: Column, name: Column, upto: Column) -> Column:
    """Start of the last word-bounded occurrence of name that starts at or before upto; null without one."""
    n = _padded(name)
    head = F.substr(_padded(sentence), F.lit(1), (upto + F.length(n)).cast("int"))
    at = F.position(F.reverse(n), F.reverse(head))
    return F.when(at > 0, F.length(head) - (at - 1) - F.length(n))


def dates(sentence: Column, anchor: Column, rules: Rules = Rules()) -> Column:
    """Struct of date_original, normalised_date (start_year, end_year, precision), note.

    Of all dates the nearest at or after the anchor, else the nearest before; only a plain year is normalised.
    """
    found = F.regexp_extract_all(sentence, F.lit(rules.dates), F.lit(0))
    gaps = F.split(sentence, rules.dates, -1)
    with_at = F.transform(found, lambda d, i: F.struct((F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i), ""))).alias("at"), d.alias("date")))
    after = F.filter(with_at, lambda x: x["at"] >= anchor)
    pick = F.when(F.size(after) > 0, F.get(after, F.lit(0))["date"]).otherwise(F.get(with_at, F.size(with_at) - 1)["date"])
    year = F.when(~pick.rlike(r"(?i)around|circa|c\.|s$|century"), F.nullif(F.regexp_extract(pick, r"\d{4}", 0), F.lit("")).cast("int"))
    norm = F.when(year.isNotNull(), F.struct(year.alias("start_year"), year.alias("end_year"), F.lit("year").alias("precision")))
    note = F.when(F.size(found) == 0, "date not stated in supporting text").when(year.isNull(), "historical expression retained; precision is not sufficient to normalise")
    return F.struct(pick.alias("date_original"), norm.alias("normalised_date"), note.alias("note"))


def events(passages: DataFrame, found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """event_id, event_type, involved_entity_ids, date_original, normalised_date, location, supports, confidence, notes."""
    # A sentence ends where no word goes on, so what matches in it matches in its passage.
    verb = "(?i)" + "|".join(p for _, p, _ in rules.events)
    said = spans.sentences(passages.filter(F.col("text").rlike(verb)).select("passage_id", "document_id", "passage_index", "text"), "text")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(name).alias("event_type"), F.col("sentence").rlike(f"(?i){p}").alias("there"), F.length(F.regexp_extract("sentence", f"(?is)^(.*?){p}", 1)).alias("verb"), F.length(F.regexp_extract("sentence", f"(?i){p}", 0)).alias("verb_length")) for k, (name, p, _) in enumerate(rules.events)])
    verbs = said.filter(F.col("sentence").rlike(verb) & ~F.col("sentence").rlike(rules.veto))
    verbs = verbs.select("*", F.explode(F.filter(kinds, lambda x: x["there"])).alias("e")).select("passage_id", "document_id", "passage_index", "sentence", "start", "end", "e.kind", "e.event_type", "e.verb", (F.col("e.verb") + F.col("e.verb_length")).alias("verb_end"))
    supports = found.select("entity_id", "canonical_name", "entity_type", F.explode("supporting_passage_ids").alias("passage_id"))
    near = verbs.join(supports, "passage_id").filter(_padded("sentence").contains(_padded("canonical_name")))
    specific = ~F.col("entity_type").isin(*SPECIFIC_NOT) & ~T.normalise_key("canonical_name").isin(*rules.vague_names)
    one = ["passage_id", "start", "end", "kind"]
    near = near.withColumn("_s", specific).withColumn("_any", F.max("_s").over(Window.partitionBy(*one)))
    near = near.filter(F.when(F.col("_any"), F.col("_s")).otherwise(~F.col("entity_type").isin(*FALLBACK_NOT)))
    before = _last_start(F.col("sentence"), F.col("canonical_name"), F.col("verb"))
    first = F.position(_padded("canonical_name"), _padded("sentence")) - 1
    distance = F.when(before.isNotNull(), F.col("verb") - before).when(F.col("sentence").rlike(rules.inverted), 10_000 + first).otherwise(1_000_000)
    near = near.withColumn("_d", distance).filter("_d < 1000000")
    best = Window.partitionBy(*one).orderBy("_d", -F.length("canonical_name"), "entity_id")
    rows = near.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    again = Window.partitionBy("event_type", "document_id", T.normalise_key("sentence")).orderBy("passage_index", "start")
    rows = rows.withColumn("_n", F.row_number().over(again)).filter("_n = 1").withColumn("d", dates(F.col("sentence"), F.col("verb_end"), rules))
    return rows.select(
        T.stable_id("evt", "event_type", "passage_id", "sentence").alias("event_id"), "event_type", F.array("entity_id").alias("involved_entity_ids"), F.col("d.date_original").alias("date_original"), F.col("d.normalised_date").alias("normalised_date"),
        F.when(F.col("entity_type").isin("place", "suburb", "street"), F.col("canonical_name")).alias("location"), F.array("passage_id").alias("supporting_passage_ids"), F.col("sentence").alias("supporting_text"), F.struct("start", "end").alias("supporting_span"),
        F.when(F.col("d.date_original").isNotNull(), 0.86).otherwise(0.76).alias("confidence"), F.col("d.note").alias("uncertainty_notes"), F.lit("event_phrase_rule_v1").alias("extraction_method"),
    )


def passage_mentions(passages: DataFrame, found: DataFrame) -> DataFrame:
    """passage_id with every entity of three characters and more whose name its text holds, whatever the case, inside words too."""
    names = found.select(F.col("entity_id").alias("name_id"), F.col("canonical_name").alias("name"))
    held = held_names(passages.select(F.col("passage_id").alias("text_id"), "text"), names, 3).withColumnsRenamed({"text_id": "passage_id", "name_id": "entity_id"})
    return held.join(found.select("entity_id", "canonical_name", "entity_type"), "entity_id").select("passage_id", "entity_id", "canonical_name", "entity_type")


def relations(passages: DataFrame, found: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """Relations by phrase and by co-mention, and the entities with the relations' targets merged in."""
    mentioned = checkpointed(passage_mentions(passages, found))  # read three times
    sentences = lambda some: spans.sentences(some.select("passage_id", "document_id", "passage_index", "text"), "text")
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(name).alias("relation_type"), F.lit(target).alias("target_type"), F.regexp_extract("sentence", f"(?i:{verb}){extra}{rules.proper}", 1).alias("target"), F.length(F.regexp_extract("sentence", f"(?s)^(.*?)(?i:{verb}){extra}{rules.proper}", 1)).alias("at"))
        for k, (name, verb, extra, target) in enumerate(rules.relations)
    ])
    # Few passages and sentences hold a verb at all; only they go through the patterns.
    verb = "(?i)" + "|".join(f"(?:{verb})" for _, verb, _, _ in rules.relations)
    verbal = sentences(passages.filter(F.col("text").rlike(verb))).filter(F.col("sentence").rlike(verb))
    hits = verbal.select("*", F.explode(F.filter(kinds, lambda x: x["target"] != "")).alias("k")).select("passage_id", "document_id", "sentence", "start", "end", "k.kind", "k.relation_type", "k.target_type", "k.at", T.clean_name("k.target").alias("target")).filter(F.length("target") >= 3)
    near = hits.join(mentioned.filter(~F.col("entity_type").isin("place", "suburb", "street")), "passage_id")
    last = _last_start(F.col("sentence"), F.col("canonical_name"), F.col("at") - F.length("canonical_name"))
    near = near.withColumn("_d", F.col("at") - last - F.length("canonical_name")).filter("_d >= 0")
    best = Window.partitionBy("passage_id", "start", "end", "kind").orderBy("_d", -F.length("canonical_name"), "entity_id")
    rows = near.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    kind = F.when((F.col("relation_type") == "DESIGNED_BY") & F.col("target").rlike(rules.firm), "organisation").otherwise(F.col("target_type"))
    rows = rows.withColumn("target_type", kind).withColumn("object_entity_id", T.stable_id("ent", "target_type", "target"))
    targets = rows.select(F.col("object_entity_id").alias("entity_id"), F.col("target").alias("canonical_name"), F.col("target_type").alias("entity_type"), F.array().cast("array<string>").alias("aliases"), F.array("passage_id").alias("supporting_passage_ids"), F.lit(0.82).alias("confidence"), F.lit("relation_target_rule_v1").alias("extraction_method"))
    columns = ["relation_type", F.col("entity_id").alias("subject_entity_id"), "object_entity_id", F.lit(None).cast("string").alias("object_value"), "passage_id", F.col("sentence").alias("supporting_text"), "start", "end"]
    by_phrase = rows.select(*columns, F.lit(0.88).alias("confidence"), F.lit("relation_phrase_rule_v1").alias("extraction_method"))

    # One subject and one place of a passage, each the longest name, in one sentence with a locative between.
    is_place = F.col("entity_type").isin("place", "suburb")
    rank = Window.partitionBy("passage_id", is_place).orderBy(-F.length("canonical_name"), "entity_id")
    tops = mentioned.withColumn("_place", is_place).withColumn("_n", F.row_number().over(rank)).filter("_n = 1")
    pair = tops.filter("NOT _place").select("passage_id", F.col("entity_id"), F.col("canonical_name").alias("subject")).join(tops.filter("_place").select("passage_id", F.col("entity_id").alias("object_entity_id"), F.col("canonical_name").alias("place")), "passage_id")
    located = sentences(passages.join(pair.select("passage_id"), "passage_id", "left_semi")).join(pair, "passage_id").withColumn("_at", F.position(_padded("subject"), _padded("sentence"))).filter("_at > 0")
    clause = F.regexp_extract(F.substr("sentence", (F.col("_at") + F.length("subject")).cast("int")), rules.locative, 0)
    located = located.filter(_padded(clause).contains(_padded("place"))).withColumn("relation_type", F.lit("LOCATED_IN"))
    located = located.withColumn("_n", F.row_number().over(Window.partitionBy("passage_id").orderBy("start"))).filter("_n = 1")
    by_place = located.select(*columns, F.lit(0.82).alias("confidence"), F.lit("co_mention_location_rule_v1").alias("extraction_method"))

    both = by_phrase.unionByName(by_place)
    again = Window.partitionBy("relation_type", "subject_entity_id", "object_entity_id", T.normalise_key("supporting_text")).orderBy("passage_id", "start")
    both = both.withColumn("_n", F.row_number().over(again)).filter("_n = 1")
    out = both.select(T.stable_id("rel", "relation_type", "subject_entity_id", "object_entity_id", "passage_id").alias("relation_id"), "relation_type", "subject_entity_id", "object_entity_id", "object_value", F.array("passage_id").alias("supporting_passage_ids"), "supporting_text", F.struct("start", "end").alias("supporting_span"), "confidence", "extraction_method")
    merged = found.withColumn("_o", F.lit(0)).unionByName(targets.withColumn("_o", F.lit(1))).groupBy("entity_id").agg(
        F.min_by(F.struct("canonical_name", "entity_type", "aliases", "confidence", "extraction_method"), F.struct("_o", "canonical_name")).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_passage_ids")))).alias("supporting_passage_ids")
    )
    return out, merged.select("entity_id", "f.canonical_name", "f.entity_type", "f.aliases", "supporting_passage_ids", "f.confidence", "f.extraction_method")


def event_relations(found: DataFrame) -> DataFrame:
    """Dated demolitions as relations."""
    rows = found.filter((F.col("event_type") == "demolition") & F.col("date_original").isNotNull()).withColumns({"subject_entity_id": F.get("involved_entity_ids", F.lit(0)), "_p": F.get("supporting_passage_ids", F.lit(0))})
    return rows.select(T.stable_id("rel", F.lit("DEMOLISHED_IN"), "subject_entity_id", "date_original", "_p").alias("relation_id"), F.lit("DEMOLISHED_IN").alias("relation_type"), "subject_entity_id", F.lit(None).cast("string").alias("object_entity_id"), F.col("date_original").alias("object_value"), "supporting_passage_ids", "supporting_text", "supporting_span", "confidence", F.lit("validated_demolition_event_relation_v1").alias("extraction_method"))


def claims(found_events: DataFrame, found_relations: DataFrame, found: DataFrame, passages: DataFrame, documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Claims with valid (their span holds their text) and conflict_group; an object is a text, `true` or an entity."""
    predicate = F.create_map(*[F.lit(x) for name, _, p in rules.events for x in (name, p)])
    names = found.select("entity_id", "canonical_name", "entity_type")
    of_events = found_events.select(
        F.col("event_id").alias("_id"), F.get("involved_entity_ids", F.lit(0)).alias("subject_id"), predicate[F.col("event_type")].alias("predicate"), F.when(F.col("date_original").isNull(), "true").otherwise("string").alias("value_kind"), F.col("date_original").alias("value_string"),
        F.lit(None).cast("string").alias("value_entity"), "supporting_text", "supporting_span", F.get("supporting_passage_ids", F.lit(0)).alias("passage_id"), "confidence", F.lit("validated_event_to_claim_v1").alias("extraction_method"), F.col("date_original").alias("temporal_qualifier"), F.col("location").alias("_place"),
    )
    of_relations = found_relations.select(
        F.col("relation_id").alias("_id"), F.col("subject_entity_id").alias("subject_id"), F.lower("relation_type").alias("predicate"), F.when(F.col("object_entity_id").isNull(), "string").otherwise("entity").alias("value_kind"), F.col("object_value").alias("value_string"), F.col("object_entity_id").alias("value_entity"),
        "supporting_text", "supporting_span", F.get("supporting_passage_ids", F.lit(0)).alias("passage_id"), "confidence", F.lit("validated_relation_to_claim_v1").alias("extraction_method"), F.lit(None).cast("string").alias("temporal_qualifier"), F.lit(None).cast("string").alias("_place"),
    )
    rows = of_events.unionByName(of_relations).join(names.withColumnRenamed("entity_id", "subject_id").withColumnRenamed("canonical_name", "subject_name").withColumnRenamed("entity_type", "_subject_type"), "subject_id")
    rows = rows.join(names.select(F.col("entity_id").alias("value_entity"), F.col("canonical_name").alias("value_name")), "value_entity", "left")
    rows = rows.join(passages.select("passage_id", "document_id", F.col("text").alias("_text")), "passage_id").join(documents.select("document_id", "source_id"), "document_id")
    rows = rows.withColumns({
        "valid": T.valid_span("_text", "supporting_span.start", "supporting_span.end", "supporting_text"), "claim_id": T.stable_id("clm", "_id", "subject_name", F.coalesce("value_string", "value_entity", F.lit("true"))),
        "geographic_qualifier": F.coalesce("_place", F.when(F.col("predicate") == "located_in", F.col("value_name"))),
    })
    explicit = F.col("valid") & F.col("temporal_qualifier").isNotNull() & ~F.col("_subject_type").isin("place", "suburb", "street", "organisation", "government_institution") & F.col("supporting_text").rlike(rules.disputed) & _padded("supporting_text").contains(_padded("subject_name"))
    rows = rows.withColumn("_explicit", explicit)
    value = F.coalesce("value_string", "value_entity", F.lit("true"))
    groups = rows.filter("_explicit").groupBy("subject_id", "predicate").agg(F.countDistinct(value).alias("v"), F.countDistinct("source_id").alias("s")).filter("v > 1 AND s > 1").select("subject_id", "predicate", T.stable_id("conflict", "subject_id", "predicate").alias("_group"))
    rows = rows.join(groups, ["subject_id", "predicate"], "left").withColumn("conflict_group", F.when(F.col("_explicit"), F.col("_group")))
    return rows.select("claim_id", F.struct(F.col("subject_id").alias("entity_id"), F.col("subject_name").alias("name")).alias("subject"), "predicate", "value_kind", "value_string", F.when(F.col("value_entity").isNotNull(), F.struct(F.col("value_entity").alias("entity_id"), F.col("value_name").alias("name"))).alias("value_entity"), "supporting_text", "supporting_span", "passage_id", "source_id", "confidence", "extraction_method", "temporal_qualifier", "geographic_qualifier", "conflict_group", "valid")


def places(documents: DataFrame, passages: DataFrame, found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One GeoJSON feature for each entity that is the best of a passage with coordinates; the first passage wins."""
    rows = passages.withColumn("coordinates", T.coordinates("text", rules.coordinates)).filter("coordinates IS NOT NULL")
    supports = found.filter(~F.col("entity_type").isin("person", "organisation", "government_institution")).select("entity_id", "canonical_name", "entity_type", "confidence", F.explode("supporting_passage_ids").alias("passage_id"))
    best = Window.partitionBy("passage_id").orderBy(F.col("confidence").desc(), F.length("canonical_name").desc(), "entity_id")
    rows = rows.join(supports, "passage_id").withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy("document_id", "passage_index"))).filter("_n = 1").join(documents.select("document_id", "source_url"), "document_id")
    suburb = F.coalesce(*[F.when(F.lower("text").contains(p.lower()), p) for p in (*rules.suburbs, rules.places[0])])
    properties = F.struct(F.col("entity_id").alias("canonical_entity_id"), F.col("canonical_name").alias("name"), "entity_type", F.nullif(F.trim(F.regexp_extract("text", rules.address, 1)), F.lit("")).alias("address"), suburb.alias("suburb"), F.col("source_url").alias("coordinate_source"), F.lit(0.98).alias("coordinate_confidence"), F.lit("point_from_source").alias("location_precision"), F.array("passage_id").alias("supporting_passage_ids"))
    return rows.select(F.lit("Feature").alias("type"), F.col("entity_id").alias("id"), F.struct(F.lit("Point").alias("type"), "coordinates").alias("geometry"), properties.alias("properties"))
