"""Queries over texts: entity mentions, words, mood, networks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col, lit

from gumshoe.catalog.registry import query
from gumshoe.catalog.scalars import _TOKENS
from gumshoe.catalog.views import VIEWS, with_views
from gumshoe.functions import language
from gumshoe.functions.text import tokens
from gumshoe.operators import mentions as m
from gumshoe.operators import words as w
from gumshoe.session import pin, shared_dir
from gumshoe.sinks import exports
from gumshoe.sources.tables import quest_from_tables, table, text_docs

# --- dictionaries: labels are words of the benchmark passages, which the documents quote ----


def _passages(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tokens(col("text")).alias("w"))


def _words(first, last):
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def _pieces(first, size):
    """The passage from a word on in pieces of so many words; the last may be shorter."""
    starts = F.sequence(lit(first), F.greatest(F.size("w"), lit(first)), lit(size))
    return F.filter(F.transform(starts, lambda at: F.array_join(F.slice("w", at, size), " ")), lambda x: x != "")


def _named(spark, sf, kind, label, altlabels=None, description=None):
    name = F.concat(lit(f"{kind}."), col("item_id").cast("string")).alias("name")
    more = [c.alias(n) for c, n in ((altlabels, "altlabels"), (description, "description")) if c is not None]
    return _passages(spark, sf).select(name, label.alias("label"), *more)


def ident_entities(spark, sf):
    return _named(spark, sf, "ident", _words(1, 2), _pieces(3, 3), F.array_join(F.slice("w", 3, F.size("w")), " "))


def org_entities(spark, sf):
    return _named(spark, sf, "org", _words(1, 4), _pieces(5, 2))


def city_entities(spark, sf):
    """The longest word of each passage."""
    return _named(spark, sf, "city", F.array_min(F.transform("w", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"])


def country_entities(spark, sf):
    """The last word of each passage by the alphabet."""
    return _named(spark, sf, "country", F.array_max("w"))


def _permuted(prefix: str, lists: str, written: str | None = None) -> str:
    """SQL rows (phrase, key): all orders of each word list in `lists`, and texts as they are written."""
    out = []
    for n in range(1, m.MAX_WORDS + 1):
        names = [f"a{i}" for i in range(n)]
        phrase = " || ' ' || ".join(f"t.ws[{x}.i]" for x in names)
        ranges = "".join(f", range(1, {n + 1}) {x}(i)" for x in names)
        distinct = "".join(f" and {x}.i <> {y}.i" for i, x in enumerate(names) for y in names[i + 1 :])
        out.append(f"select '{prefix}.' || item_id as name, {phrase} as phrase from (select item_id, unnest({lists}) as ws from passages_w) t{ranges} where len(t.ws) = {n}{distinct}")
    if written:
        out.append(f"select '{prefix}.' || item_id, {written} from passages_w")
    return f"select phrase, min(name) as key from ({' union all '.join(out)}) where phrase <> '' group by 1"


def _pieces_sql(first: int, size: int) -> str:
    return f"list_transform(range({first}, len(w) + 1, {size}), lambda s: w[s:s + {size - 1}])"


VIEWS["passages_w"] = ((), f"select item_id, {_TOKENS} as w from benchmark")
VIEWS["dict_idents"] = (("passages_w",), _permuted("ident", f"list_concat([w[1:2]], {_pieces_sql(3, 3)})"))
VIEWS["dict_orgs"] = (("passages_w",), _permuted("org", f"list_concat([w[1:4]], {_pieces_sql(5, 2)})"))
VIEWS["dict_cities"] = (("passages_w",), _permuted("city", "[[list_min(list_transform(w, lambda x: {'n': -length(x), 'x': x})).x]]"))
VIEWS["dict_countries"] = (("passages_w",), _permuted("country", "[[list_max(w)]]"))
VIEWS["doc_tokens"] = ((), f"select 'source.d' || doc_id as source, {_TOKENS} as t from documents")
VIEWS["doc_grams"] = (
    ("doc_tokens",),
    """select source, phrase, count(*) as times from (
        select source, unnest(list_concat(
            list_transform(range(2, len(t)), lambda i: t[i]),
            list_transform(range(2, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]),
            list_transform(range(2, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]),
            list_transform(range(2, len(t) - 3), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3]))) as phrase
        from doc_tokens) group by 1, 2""",
)
VIEWS["m_idents"] = (
    ("doc_grams", "dict_idents", "dict_orgs", "dict_cities", "dict_countries"),
    """select source, key, count(*) as n, sum(times)::bigint as occurrences from doc_grams join dict_idents using (phrase)
        where phrase not in (select phrase from dict_orgs) and phrase not in (select phrase from dict_cities)
        and phrase not in (select phrase from dict_countries) group by 1, 2""",
)


def _dictionaries(spark, sf):
    return [
        m.phrase_dict(f(spark, sf)) for f in (ident_entities, org_entities, city_entities, country_entities)
    ]


def ident_mentions(spark, sf):
    idents, *taken = _dictionaries(spark, sf)
    return m.match_idents(text_docs(spark, sf), idents, *taken)


_MENTIONS: dict[tuple[str, str], DataFrame] = {}


def mention_rows(spark, sf):
    """The stored result of an analysis run: written once for a session, then read by every later question."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MENTIONS:
        _MENTIONS[key] = pin(m.mention_table(idents=ident_mentions(spark, sf)))
    return _MENTIONS[key]


@query("mention_table", with_views("select source, 'idents' as kind, key, n from m_idents", "m_idents"))
def mention_table(spark, sf):
    return mention_rows(spark, sf)


@query("phrase_dict", with_views("select phrase, key from dict_idents", "dict_idents"))
def phrase_dict(spark, sf):
    return m.phrase_dict(ident_entities(spark, sf))


_DESC = _permuted("ident", "[w[1:2]]", "array_to_string(w[3:], ' ')")


@query("phrase_dict_desc", with_views(f"select * from ({_DESC})", "passages_w"))
def phrase_dict_desc(spark, sf):
    return m.phrase_dict_desc(ident_entities(spark, sf))


@query("match_idents", with_views("select source, key, n, occurrences from m_idents", "m_idents"))
def match_idents(spark, sf):
    idents, *taken = _dictionaries(spark, sf)
    return m.match_idents(text_docs(spark, sf), idents, *taken, occurrences=True)


def _match(dictionary: str) -> str:
    return with_views(
        f"select source, key, count(*) as n from doc_grams join {dictionary} using (phrase) group by 1, 2",
        "doc_grams", dictionary,
    )


@query("match_orgs", _match("dict_orgs"))
def match_orgs(spark, sf):
    return m.match_phrases(text_docs(spark, sf), m.phrase_dict(org_entities(spark, sf)))


@query("match_cities", _match("dict_cities"))
def match_cities(spark, sf):
    return m.match_phrases(text_docs(spark, sf), m.phrase_dict(city_entities(spark, sf)))


@query(
    "match_countries",
    with_views(
        r"""select 'source.d' || doc_id as source, key, count(*) as n from documents join dict_countries
        on strpos(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), phrase) > 0 group by 1, 2""",
        "dict_countries",
    ),
)
def match_countries(spark, sf):
    return m.match_substrings(text_docs(spark, sf), m.phrase_dict(country_entities(spark, sf)))


@query(
    "sink_mentions",
    with_views(
        r"""select 'idents' as kind, key, source from m_idents
        union all select distinct 'orgs', key, source from doc_grams join dict_orgs using (phrase)
        union all select distinct 'cities', key, source from doc_grams join dict_cities using (phrase)
        union all select distinct 'countries', key, 'source.d' || doc_id from documents join dict_countries
        on strpos(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), phrase) > 0""",
        "m_idents",
    ),
)
def sink_mentions(spark, sf):
    """The inverted report of every kind, written by kind and read back."""
    idents, orgs, cities, countries = _dictionaries(spark, sf)
    docs = text_docs(spark, sf)
    named = m.match_kinds(docs, idents=m.free_phrases(idents, orgs, cities, countries), orgs=orgs, cities=cities)
    found = named.unionByName(m.mention_table(countries=m.match_substrings(docs, countries)))
    path = os.path.join(shared_dir(spark), "exports", uuid.uuid4().hex)
    exports.write_mentions(m.mentioning_sources(found), path)
    return exports.read_mentions(spark, path)


# --- words -------------------------------------------------------------------------------

_STOPS = " ".join(
    f"when '{k}' then [{', '.join(repr(x) for x in dict.fromkeys(ws))}]" for k, ws in language.STOP_WORDS.items()
)
_N_WORDS = ", ".join(
    f"len(list_filter(t, lambda x: x in ({', '.join(repr(x) for x in dict.fromkeys(ws))}))) as n_{k}"
    for k, ws in language.STOP_WORDS.items()
)
VIEWS["topic"] = (
    ("doc_tokens",),
    f"""select source, unnest(list_filter(t, lambda x: length(x) > 2 and regexp_matches(x, '^\\p{{L}}+$')
        and not list_contains(case lang {_STOPS} else []::varchar[] end, x)
        and not list_contains([{', '.join(repr(x) for x in w.DAY_MONTH)}], x))) as word from (
        select source, t, case when greatest(n_en, n_fr, n_de, n_es) = 0 then '' when n_en >= greatest(n_fr, n_de, n_es) then 'en'
        when n_fr >= greatest(n_de, n_es) then 'fr' when n_de >= n_es then 'de' else 'es' end as lang
        from (select source, t, {_N_WORDS} from doc_tokens))""",
)
VIEWS["topic_counts"] = (("topic",), "select source, word, count(*) as n from topic group by 1, 2")


def _bad_words(spark, sf):
    return _passages(spark, sf).select(F.explode(F.filter("w", lambda x: F.length(x) % 2 == 0)).alias("word"))


def _listed_words(spark, sf):
    return _passages(spark, sf).select(F.explode("w").alias("word"))


@query(
    "word_counts",
    with_views(
        """select source, word, n from topic_counts where word not in (select unnest(list_filter(w, lambda x: length(x) % 2 = 0)) from passages_w)
        qualify row_number() over (partition by source order by n desc, word) <= 30""",
        "topic_counts", "passages_w",
    ),
)
def word_counts(spark, sf):
    return w.word_counts(text_docs(spark, sf), bad=_bad_words(spark, sf))


@query(
    "word_counts_listed",
    with_views(
        """select source, word, n from topic_counts where word in (select unnest(w) from passages_w)
        qualify row_number() over (partition by source order by n desc, word) <= 30""",
        "topic_counts", "passages_w",
    ),
)
def word_counts_listed(spark, sf):
    return w.word_counts(text_docs(spark, sf), only=_listed_words(spark, sf))


VIEWS["found_people"] = (
    ("dict_idents", "dict_countries"),
    r"""select 'source.d' || doc_id as source, person, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g'), '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b')) as person from documents)
        where lower(person) not in (select phrase from dict_idents) and lower(person) not in (select phrase from dict_countries)
        group by 1, 2""",
)


def _people(spark, sf):
    idents, _, _, countries = _dictionaries(spark, sf)
    return m.people(text_docs(spark, sf), idents=idents, countries=countries)


@query("people", with_views("select source, person, n from found_people", "found_people"))
def people(spark, sf):
    return _people(spark, sf)


@query(
    "flt_bad_names",
    with_views(
        """select distinct part as person from (select p_name as part from part union all select p_brand || ']' from part)
        where part not like '%]%' and part not in ('red widget', 'small ring')""",
    ),
)
def flt_bad_names(spark, sf):
    parts = table(spark, sf, "part")
    names = parts.select(col("p_name").alias("person")).union(parts.select(F.concat("p_brand", lit("]")))).distinct()
    bad = parts.where(col("p_name").isin("red widget", "small ring")).select(col("p_name").alias("word"))
    return m.flt_bad_names(names, bad=bad)


VIEWS["lexicon"] = (
    ("passages_w",),
    """select word, (length(word) % 5 - 2) / 2.0 as polarity, (length(word) % 3) / 2.0 as subjectivity
        from (select distinct unnest(w) as word from passages_w)""",
)
def _in(words) -> str:
    return "(" + ", ".join(f"'{x}'" for x in words) + ")"


def valence_sql(texts: str, key: str) -> str:
    """SQL rows (key, total, word, p, s, v): each token of (key, t) with the lexicon's values in thousandths and its
    valence in `words.UNITS`, null where it is not listed."""
    before = lambda n, words: f"i > {n} and t[i - {n}] in {_in(words)}"
    boost = " + ".join(
        f"(case when {before(n, w.BOOSTERS)} then {e} when {before(n, w.DAMPERS)} then {-e} else 0 end)" for n, e in enumerate(w.BOOST_BY_DISTANCE, 1)
    )
    near = " or ".join(f"({before(n, w.NEGATIONS)})" for n in (1, 2, 3))
    return f"""select {key}, total, word, p, s, case when p = 0 then 0 when turned then (p * 1000 + sign(p) * boost) * {w.TURNED} // 100
        else p * 1000 + sign(p) * boost end::bigint * side as v from (
        select {key}, total, t[i] as word, {boost} as boost, coalesce({near}, false) as turned,
        case when coalesce(b, 0) = 0 then 2 when i < b then 1 when i > b then 3 else 2 end as side from (
        select {key}, len(t) as total, t, list_position(t, 'but') as b, unnest(case when len(t) = 0 then [null] else range(1, len(t) + 1) end) as i from {texts}))
        left join (select word, round(polarity * 1000)::bigint as p, round(subjectivity * 1000)::bigint as s from lexicon) using (word)"""


_THOUSANDTHS = "(sign({0}) * ((abs({0}) * 2 + {1}) // ({1} * 2)) / 1000)::double"
VIEWS["moods"] = (
    ("doc_tokens", "lexicon"),
    f"""select source, case when x / n > 0.1 then 'Positive' when x / n < -0.1 then 'Negative' else 'Neutral' end as mood,
        {_THOUSANDTHS.format('v', f'(n * {w.UNITS // 1000})')} as polarity, {_THOUSANDTHS.format('su', 'n')} as subjectivity,
        {_THOUSANDTHS.format('(pos * 1000)', 'total')} as positive, {_THOUSANDTHS.format('((total - pos - neg) * 1000)', 'total')} as neutral,
        {_THOUSANDTHS.format('(neg * 1000)', 'total')} as negative, round(x / sqrt(x * x + 15), 3) as compound from (
        select *, v::double / {w.UNITS}.0::double as x from (
        select source, greatest(max(total), 1) as total, greatest(count(v), 1) as n, coalesce(sum(s), 0)::bigint as su, coalesce(sum(v), 0)::bigint as v,
        count(*) filter (v > 0) as pos, count(*) filter (v < 0) as neg from ({valence_sql("doc_tokens", "source")}) group by 1))""",
)
EXACT_MEAN = "(sum({0}::decimal(20, 9))::double / count({0}))"


def lexicon(spark, sf):
    listed = _listed_words(spark, sf).distinct()
    return listed.select(
        "word",
        ((F.length("word") % 5 - 2) / 2.0).alias("polarity"),
        ((F.length("word") % 3) / 2.0).alias("subjectivity"),
    )


@query("mood", with_views("select * from moods", "moods"))
def mood(spark, sf):
    return w.lexicon_mood(text_docs(spark, sf), lexicon(spark, sf))


@query(
    "mood_rollup",
    with_views(
        "select mood, count(*) as n, " + ", ".join(f"round({EXACT_MEAN.format(c)}, 4) as {c}" for c in ("polarity", "subjectivity", "compound")) + " from moods group by 1",
        "moods",
    ),
)
def mood_rollup(spark, sf):
    return w.mood_rollup(w.lexicon_mood(text_docs(spark, sf), lexicon(spark, sf)))


def _counts(spark, sf):
    docs = text_docs(spark, sf)
    engines = w.Engines()
    engines.register("words", w.words_engine)
    engines.register(
        "orgs",
        lambda d, dictionary: m.match_phrases(d, dictionary).withColumn("bucket", lit("orgs")),
    )
    words = engines.analyse(docs, ["words"])
    return words.unionByName(engines.analyse(docs, ["orgs"], dictionary=m.phrase_dict(org_entities(spark, sf))))


@query(
    "counts_rollup",
    with_views(
        """select engine, bucket, key, sum(n)::bigint as n from (
        select source, 'words' as engine, 'commons' as bucket, word as key, n from topic_counts
        union all select source, 'orgs', 'orgs', key, count(*) from doc_grams join dict_orgs using (phrase) group by 1, 4)
        where source in (select name from sources where list_has_any(cats, ['fr', 'en'])) group by 1, 2, 3""",
        "topic_counts", "doc_grams", "dict_orgs", "sources",
    ),
)
def counts_rollup(spark, sf):
    from gumshoe.operators.filters import filter_cats

    chosen = filter_cats(quest_from_tables(spark, sf).sources, ["fr", "en"])
    return w.counts_rollup(_counts(spark, sf), chosen)


@query(
    "cloud_terms",
    with_views(
        """, t as (select word as key, sum(n)::bigint as n from topic_counts group by 1 order by n desc, key limit 20)
        select key, n, round(n / (select max(n) from t), 6) as weight from t""",
        "topic_counts",
    ),
)
def cloud_terms(spark, sf):
    counts = w.words_engine(text_docs(spark, sf))
    return w.cloud_terms(counts).withColumn("weight", F.round("weight", 6))


@query(
    "translation_lookup",
    with_views(
        """, terms as (select distinct d.lang, t.word as term from topic_counts t join documents d on 'source.d' || d.doc_id = t.source),
        memory as (select distinct 'fr' as lang, unnest(w) as term from passages_w)
        select terms.lang, terms.term, case when memory.term is null then terms.term
            when length(terms.term) > 6 then upper(terms.term) else 'x_' || terms.term end as translation
        from terms left join (select 'en' as lang, term from memory) memory on memory.lang = terms.lang and memory.term = terms.term""",
        "topic_counts", "passages_w",
    ),
)
def translation_lookup(spark, sf):
    docs = text_docs(spark, sf)
    terms = w.words_engine(docs).join(docs.select("source", "lang"), "source").select("lang", col("key").alias("term")).distinct()
    known = _listed_words(spark, sf).distinct().select(lit("en").alias("lang"), col("word").alias("term"))
    memory = known.withColumn("translation", F.concat(lit("x_"), "term"))
    fresh = known.where(F.length("term") > 6).withColumn("translation", F.upper("term"))
    return w.translation_lookup(terms, w.translation_update(memory, fresh)).select("lang", "term", "translation")


# --- networks ----------------------------------------------------------------------------

START = "ident.0"
STARTS = [f"ident.{i}" for i in range(12)]
_STARTS = "(" + ", ".join(f"'{s}'" for s in STARTS) + ")"
VIEWS["level1"] = (
    ("m_idents", "idents"),
    f"""select a.key as ident, b.key as other, a.source from m_idents a join m_idents b on a.source = b.source and a.key <> b.key
        join idents i on i.name = b.key where a.key in {_STARTS} and b.key not in ('ident.3')
        and a.key not in ('ident.3') and (len(i.cats) = 0 or i.cats[1] <> 'furniture')""",
)


@query("ident_network", with_views("select ident, other, count(*) as n from level1 group by 1, 2", "level1"))
def ident_network(spark, sf):
    rows = m.ident_network(quest_from_tables(spark, sf), mention_rows(spark, sf), STARTS, ["furniture"], ["ident.3"])
    return m.network_counts(rows)


@query("ident_network_sources", with_views("select ident, other, source from level1", "level1"))
def ident_network_sources(spark, sf):
    return m.ident_network(quest_from_tables(spark, sf), mention_rows(spark, sf), STARTS, ["furniture"], ["ident.3"])


@query(
    "ident_network_2",
    with_views(
        """, near as (select distinct b.key from m_idents a join m_idents b on a.source = b.source and a.key <> b.key
            join raw_idents i on i.name = b.key where a.key = 'ident.0')
        select c.key as other, count(*) as n from near join m_idents b on b.key = near.key
        join m_idents c on c.source = b.source and c.key <> b.key and c.key <> 'ident.0'
        join raw_idents i on i.name = c.key group by 1""",
        "m_idents", "raw_idents",
    ),
)
def ident_network_2(spark, sf):
    return m.ident_network_2(quest_from_tables(spark, sf), mention_rows(spark, sf), START)


@query(
    "network_totals",
    with_views(
        """select a.key as ident, count(*) as n_sources, sum(s.size - 1)::bigint as n_shared from m_idents a
        join (select source, count(*) as size from m_idents group by 1) s using (source) group by 1""",
        "m_idents",
    ),
)
def network_totals(spark, sf):
    return m.network_totals(mention_rows(spark, sf))


_OCCURS = f"""select a.key as ident, a.source, c.kind, c.name from m_idents a join citations c on c.source = a.source
    where a.key in {_STARTS} and c.kind in ('events', 'idents') and c.name <> a.key"""


@query("ident_occurrences", with_views(_OCCURS, "m_idents", "citations"))
def ident_occurrences(spark, sf):
    return m.ident_occurrences(quest_from_tables(spark, sf), mention_rows(spark, sf), STARTS)


@query(
    "missing_links",
    with_views(
        f"""select distinct ident, name as event from ({_OCCURS}) o where kind = 'events'
        and not exists (select 1 from raw_links l where l.lfrom = o.ident and l.lto = o.name)""",
        "m_idents", "citations", "raw_links",
    ),
)
def missing_links(spark, sf):
    return m.missing_links(quest_from_tables(spark, sf), mention_rows(spark, sf), STARTS)


@query(
    "missing_relations",
    with_views(
        f"""select distinct ident, name as other from ({_OCCURS}) o where kind = 'idents'
        and not exists (select 1 from raw_relations r where r.rfrom = o.ident and r.rto = o.name)
        and not exists (select 1 from raw_relations r where r.rto = o.ident and r.rfrom = o.name)""",
        "m_idents", "citations", "raw_relations",
    ),
)
def missing_relations(spark, sf):
    return m.missing_relations(quest_from_tables(spark, sf), mention_rows(spark, sf), STARTS)


@query(
    "suggest_idents",
    with_views("select distinct replace(person, ' ', '') as name, person as label from found_people", "found_people"),
)
def suggest_idents(spark, sf):
    return m.suggest_idents(_people(spark, sf))


@query(
    "suggest_links",
    with_views(
        "select 'link_label' as label, split_part(key, '.', 2) as \"from\", split_part(source, '.', 2) as \"to\" from m_idents",
        "m_idents",
    ),
)
def suggest_links(spark, sf):
    return m.suggest_links(mention_rows(spark, sf))


@query(
    "ident_profile",
    with_views(
        "select i.name, i.label, i.country, a.source from raw_idents i left join m_idents a on a.key = i.name where i.name = 'ident.0'",
        "raw_idents", "m_idents",
    ),
)
def ident_profile(spark, sf):
    return m.ident_profile(quest_from_tables(spark, sf), mention_rows(spark, sf), START)
