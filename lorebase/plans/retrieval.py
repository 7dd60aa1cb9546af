"""Full-text, vector and hybrid retrieval queries."""

from pyspark.sql import functions as F

from lorebase.functions.columns import top_per_key
from lorebase.functions.vectors import cosine_distance
from lorebase.operators import bm25, fulltext, hybrid, nearest, quantised, ranked_sets
from lorebase.plans.registry import joined, query, rounded
from lorebase.sources.scratch import kept, passing, scratch_path

_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '([\p{{L}}\p{{N}}]+)', 1)"


def _tokens_sql(table: str, text: str) -> str:
    return f"""
tok as (select tenant_id, id, unnest(l) as lexeme, cast(generate_subscripts(l, 1) as int) as position
        from (select tenant_id, id, {_WORDS.format(text)} as l from {table}))"""


def _fts_sql(table: str, text: str, queries: str = "search_queries") -> str:
    """The rows of the text side, straight from the definition."""
    return f"""{_tokens_sql(table, text)},
qw as (select qid, tenant_id, list_distinct({_WORDS.format('query_text')}) as w from {queries}),
qt as (select qid, tenant_id, unnest(w) as lexeme, cast(len(w) as int) as terms from qw),
hit as (select qt.qid, tok.id, qt.lexeme, qt.terms, tok.position from qt join tok using (tenant_id, lexeme)),
matched as (select qid, id, terms from hit group by qid, id, terms having count(distinct lexeme) = terms),
one as (select qid, id, sum(1.0 / (j * j)) * 0.1 / 1.64493406685 as r from (
          select qid, id, cast(row_number() over (partition by qid, id order by position) as double) as j
          from hit join matched using (qid, id) where matched.terms = 1) z group by qid, id),
near as (select a.qid, a.id, sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.position - b.position) / 1.5 - 2))))) as l
         from hit a join matched m on m.qid = a.qid and m.id = a.id
         join hit b on a.qid = b.qid and a.id = b.id and a.lexeme < b.lexeme and abs(a.position - b.position) <= 100
         group by a.qid, a.id),
ranked as (select m.qid, m.id, cast(case when m.terms = 1 then one.r when near.l is null then 1e-16 else 1 - exp(near.l) end as float) as r
           from matched m left join one on one.qid = m.qid and one.id = m.id left join near on near.qid = m.qid and near.id = m.id),
fts as (select qid, id, r, cast(row_number() over (partition by qid order by r desc, id) as int) as rk from ranked)"""


def _vec_sql(table: str, queries: str = "search_queries", limit: int = 10, pre: bool = False) -> str:
    same = "and c.tenant_id = q.tenant_id" if pre else ""
    return f"""
cand as (select * from (
  select qid, id, tenant_id, d, row_number() over (partition by qid order by d, id) as place from (
    select q.qid, c.id, c.tenant_id, round(list_cosine_distance(cast(c.embedding as double[]), cast(q.query_vector as double[])), 12) as d
    from {queries} q join {table} c on q.query_vector is not null and c.embedding is not null {same}) x) y
  where place <= greatest({limit} * 50, 200)),
vec as (select * from (select c.qid, c.id, c.d, cast(row_number() over (partition by c.qid order by c.d, c.id) as int) as rk
  from cand c join {queries} q on q.qid = c.qid and q.tenant_id = c.tenant_id) z where rk <= 4 * {limit})"""


def _hits_sql(table: str, fields, limit: int = 10) -> str:
    cols = ", ".join(f"c.{f}" for f in fields)
    return f"""
select s.qid, c.tenant_id, s.rank, s.id, {cols}, round(cast(coalesce(s.r, 0) as double), 6) as fts_rank,
  round(cast(cast(coalesce(s.d, 1) as float) as double), 6) as vec_distance,
  round(cast(cast(s.score as float) as double), 6) as combined_score
from (select *, cast(row_number() over (partition by qid order by score desc, id) as int) as rank from (
    select coalesce(f.qid, v.qid) as qid, coalesce(f.id, v.id) as id, f.r, v.d,
      coalesce(1.0 / cast(60 + f.rk as double), 0) + coalesce(1.0 / cast(60 + v.rk as double), 0) as score
    from fts f full join vec v on f.qid = v.qid and f.id = v.id) x) s
join {table} c on c.id = s.id where s.rank <= {limit}"""


def _comparable(hits):
    return rounded(hits, fts_rank=6, vec_distance=6, combined_score=6)


# --- text ----------------------------------------------------------------------
@query("text_tokens", f"with {_tokens_sql('semantic_index', 'summary_text')} select tenant_id, id, lexeme, position from tok", ["semantic_index"])
def text_tokens(T):
    return fulltext.analyze(T["semantic_index"], "summary_text", ["tenant_id", "id"], "simple")


@query("text_lexemes_english")
def text_lexemes_english(T):
    return fulltext.analyze(T["semantic_index"], "summary_text", ["tenant_id", "id"])


@query(
    "text_postings",
    f"""with {_tokens_sql('semantic_index', 'summary_text')}
select tenant_id, lexeme, id, string_agg(cast(position as varchar), '|' order by position) as positions from tok group by tenant_id, lexeme, id""",
    ["semantic_index"],
)
def text_postings(T):
    return joined(fulltext.postings(T["semantic_index"], "summary_text", "simple"), "positions")


@query(
    "text_query_terms",
    f"""with qw as (select qid, tenant_id, list_distinct({_WORDS.format('query_text')}) as w from search_queries)
select qid, tenant_id, unnest(w) as lexeme, cast(len(w) as int) as terms from qw""",
    ["search_queries"],
)
def text_query_terms(T):
    return fulltext.query_terms(T["search_queries"], "simple")


def _ranked(T, config):
    return ranked_sets.RankedSets(fulltext.query_terms(T["search_queries"], config), T["semantic_index"], "summary_text", config)


def _positions(T):
    """Every match of every query with its position, which is that of its set."""
    sets = _ranked(T, "simple")
    placed = fulltext.fts_positions(sets.ranks().withColumnRenamed("sid", "qid")).withColumnRenamed("qid", "sid")
    return sets.of_queries(placed).select("qid", "id", "r", "fts_rk")


@query("text_match", f"with {_fts_sql('semantic_index', 'summary_text')} select qid, id from matched", ["semantic_index", "search_queries"])
def text_match(T):
    sets, members = fulltext.word_sets(fulltext.query_terms(T["search_queries"], "simple"))
    return fulltext.Matches(sets, T["semantic_index"], "summary_text", "simple").by_query(members)


@query(
    "text_rank",
    f"with {_fts_sql('semantic_index', 'summary_text')} select qid, id, round(cast(r as double), 6) as r, cast(rk as bigint) as rk from fts",
    ["semantic_index", "search_queries"],
)
def text_rank(T):
    return rounded(_positions(T).withColumnRenamed("fts_rk", "rk"), r=6)


@query("text_rank_english")
def text_rank_english(T):
    return _ranked(T, "english").by_query()


def _bm25_sql(corpus: str, limit: int = 10) -> str:
    return f"""{_tokens_sql(corpus, 'summary_text')},
docs as (select tenant_id, id, count(*) as len from tok group by all),
size as (select tenant_id, cast(count(*) as double) as n, cast(sum(len) as double) / count(*) as average from docs group by all),
tf as (select tenant_id, lexeme, id, cast(count(*) as double) as tf from tok group by all),
df as (select tenant_id, lexeme, cast(count(*) as double) as df from tf group by all),
qt as (select qid, tenant_id, unnest(list_distinct({_WORDS.format('query_text')})) as lexeme from search_queries),
scored as (select qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 9) as score
  from qt join df using (tenant_id, lexeme) join tf using (tenant_id, lexeme) join docs using (tenant_id, id) join size using (tenant_id) group by qid, id)
select qid, cast(rank as int) as rank, id, round(score, 6) as score
from (select *, row_number() over (partition by qid order by score desc, id) as rank from scored) r where rank <= {limit}"""


@query("text_rank_bm25", f"with {_bm25_sql('semantic_index')}", ["semantic_index", "search_queries"])
def text_rank_bm25(T):
    index = bm25.build(T["semantic_index"], "summary_text", "simple")
    return rounded(bm25.search(T["search_queries"], index, config="simple"), score=6)


_CHANGED = """later as (select id, tenant_id, case when id % 7 = 3 then summary_text || ' revised ' || split_part(summary_text, ' ', 1) else summary_text end as summary_text
  from semantic_index where id % 11 <> 5)"""


@query("text_rank_bm25_changed", f"with {_CHANGED},{_bm25_sql('later')}", ["semantic_index", "search_queries"])
def text_rank_bm25_changed(T):
    """The same after an eleventh of the documents went and a seventh changed, on the index with these changes."""
    rows = T["semantic_index"].select("id", "tenant_id", "summary_text")
    with passing(rows.sparkSession, "bm25-changed"):  # the index before the changes goes
        index = bm25.build(rows, "summary_text", "simple")
        text = F.concat("summary_text", F.lit(" revised "), F.split_part("summary_text", F.lit(" "), F.lit(1)))
        new = rows.filter("id % 7 = 3 and id % 11 <> 5").withColumn("summary_text", text)
        index = bm25.changed(index, rows.filter("id % 11 = 5"), new, "summary_text", "simple", scratch_path(rows.sparkSession, "bm25-changed"))
    return rounded(bm25.search(T["search_queries"], index, config="simple"), score=6)


# --- vectors ---------------------------------------------------------------------
@query(
    "vector_distance",
    """select a.id, round(list_cosine_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as d
from semantic_index a join embeddings b on b.vec_id = a.id + 1 where a.embedding is not null""",
    ["semantic_index"],
)
def vector_distance(T):
    near = T["embeddings"].select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("other"))
    rows = T["semantic_index"].filter("embedding is not null").join(near, "id")
    return rounded(rows.select("id", cosine_distance("embedding", "other").alias("d")), d=6)


@query(
    "vector_candidates",
    f"with {_vec_sql('semantic_index')} select qid, id, tenant_id, round(d, 6) as d from cand",
    ["semantic_index", "search_queries"],
)
def vector_candidates(T):
    return rounded(nearest.vec_candidates(T["search_queries"], T["semantic_index"]), d=6)


@query(
    "vector_candidates_blocks",
    f"with {_vec_sql('semantic_index')} select qid, id, tenant_id, round(d, 6) as d from cand",
    ["semantic_index", "search_queries"],
)
def vector_candidates_blocks(T):
    """The same with queries in small blocks, as a batch too large for one has them."""
    return rounded(nearest.vec_candidates(T["search_queries"], T["semantic_index"], block_bytes=4 << 20), d=6)


@query(
    "vector_ranks_tenant_after",
    f"with {_vec_sql('semantic_index')} select qid, id, round(d, 6) as d, rk as vec_rk from vec",
    ["semantic_index", "search_queries"],
)
def vector_ranks_tenant_after(T):
    found = nearest.vec_candidates(T["search_queries"], T["semantic_index"])
    return rounded(nearest.vec_ranks(found, T["search_queries"]), d=6)


@query(
    "vector_ranks_tenant_before",
    f"with {_vec_sql('semantic_index', pre=True)} select qid, id, round(d, 6) as d, rk as vec_rk from vec",
    ["semantic_index", "search_queries"],
)
def vector_ranks_tenant_before(T):
    found = nearest.vec_candidates(T["search_queries"], T["semantic_index"], tenant_filter="pre")
    return rounded(nearest.vec_ranks(found, T["search_queries"]), d=6)


def _approximate(T):
    cells = nearest.fitted_cells(T["search_queries"], T["semantic_index"])
    return nearest.vec_candidates(T["search_queries"], T["semantic_index"], cells=cells)


@query("vector_candidates_approximate")
def vector_candidates_approximate(T):
    return _approximate(T)


@query("vector_approximate_recall")
def vector_approximate_recall(T):
    return nearest.recall(_approximate(T), nearest.vec_candidates(T["search_queries"], T["semantic_index"]))


def _coded(T):
    coded = kept(quantised.codes(T["semantic_index"]), "codes")
    return quantised.vec_candidates(T["search_queries"], T["semantic_index"], coded)


@query(
    "vector_candidates_coded",
    f"""with {_vec_sql('semantic_index')} select qid, id, round(d, 6) as d from cand where place <= 10""",
    ["semantic_index", "search_queries"],
)
def vector_candidates_coded(T):
    """The ten nearest rows, found on codes and checked exactly."""
    best = top_per_key(_coded(T).drop("certain"), ["qid"], ["d", "id"], 10, rank="place")
    return rounded(best.select("qid", "id", "d"), d=6)


@query("vector_coded_recall")
def vector_coded_recall(T):
    return nearest.recall(_coded(T), nearest.vec_candidates(T["search_queries"], T["semantic_index"]))


# --- hybrid ----------------------------------------------------------------------
@query(
    "search_catalog",
    f"with {_fts_sql('semantic_index', 'summary_text')},{_vec_sql('semantic_index')}{_hits_sql('semantic_index', hybrid.CATALOG_FIELDS)}",
    ["semantic_index", "search_queries"],
)
def search_catalog(T):
    return _comparable(hybrid.search_catalog(T["search_queries"], T, config="simple"))


@query("search_catalog_english")
def search_catalog_english(T):
    return _comparable(hybrid.search_catalog(T["search_queries"], T))


@query(
    "search_documents",
    f"with {_fts_sql('document_chunks', 'content')},{_vec_sql('document_chunks')}{_hits_sql('document_chunks', hybrid.DOCUMENT_FIELDS)}",
    ["document_chunks", "search_queries"],
)
def search_documents(T):
    return _comparable(hybrid.search_documents(T["search_queries"], T, config="simple"))


_TEXT_ONLY = "vec as (select cast(null as varchar) as qid, cast(null as bigint) as id, cast(null as double) as d, cast(null as bigint) as rk where false)"


@query(
    "search_catalog_text_only",
    f"with {_fts_sql('semantic_index', 'summary_text')},{_TEXT_ONLY}{_hits_sql('semantic_index', hybrid.CATALOG_FIELDS)}",
    ["semantic_index", "search_queries"],
)
def search_catalog_text_only(T):
    return _comparable(hybrid.search_catalog(T["search_queries"], T, config="simple", vectors=False))


@query(
    "search_fusion",
    f"""with {_fts_sql('semantic_index', 'summary_text')},{_vec_sql('semantic_index')}
select qid, id, round(score, 8) as score from (
  select coalesce(f.qid, v.qid) as qid, coalesce(f.id, v.id) as id,
    coalesce(1.0 / cast(60 + f.rk as double), 0) + coalesce(1.0 / cast(60 + v.rk as double), 0) as score
  from fts f full join vec v on f.qid = v.qid and f.id = v.id) x""",
    ["semantic_index", "search_queries"],
)
def search_fusion(T):
    fts = _positions(T)
    found = nearest.vec_candidates(T["search_queries"], T["semantic_index"])
    fused = hybrid.rrf(fts, nearest.vec_ranks(found, T["search_queries"]))
    return rounded(fused.select("qid", "id", "score"), score=8)


_SEARCH = f"""with {_fts_sql('semantic_index', 'summary_text')},{_vec_sql('semantic_index')},
hits as ({_hits_sql('semantic_index', hybrid.CATALOG_FIELDS)})"""


@query(
    "search_authority_order",
    _SEARCH
    + """select qid, id, rank, authority_tier, cast(row_number() over (partition by qid order by case authority_tier when 'sacred' then 1 when 'canon' then 2
  when 'operational' then 3 when 'experimental' then 4 when 'archived' then 5 when 'deprecated' then 6 end nulls last, rank) as int) as authority_rank
from hits join (select id, authority_tier from semantic_index) using (id)""",
    ["semantic_index", "search_queries"],
)
def search_authority_order(T):
    hits = hybrid.search_catalog(T["search_queries"], T, config="simple")
    ordered = hybrid.rerank_by_authority(hits, T["semantic_index"])
    return ordered.select("qid", "id", "rank", "authority_tier", "authority_rank")


# What stands for the row of a source table.
_LABELS = {
    "project_knowledge": "title", "brand_messaging": "category", "agent_identity": "callsign", "decisions": "title",
    "known_rules": "rule_type", "sop_registry": "title", "tasks": "title", "document_chunks": "source_name",
}
_ALL_SOURCES = " union all ".join(
    f"select '{t}' as source_table, cast({key} as varchar) as source_id, {_LABELS[t]} as label from {t}" for t, key in hybrid.SOURCE_KEYS.items()
)


@query(
    "search_source_rows_all",
    _SEARCH + f""", src as ({_ALL_SOURCES})
select qid, rank, source_table, source_id, label from hits join src using (source_table, source_id)""",
    ["semantic_index", "search_queries", *hybrid.SOURCE_KEYS],
)
def search_source_rows_all(T):
    """The source rows of the hits in all eight source tables."""
    return _source_rows(T)


@query(
    "search_source_rows",
    _SEARCH + f""", src as ({_ALL_SOURCES})
select qid, rank, source_table, source_id, label from hits join src using (source_table, source_id) where rank <= 3""",
    ["semantic_index", "search_queries", *hybrid.SOURCE_KEYS],
)
def search_source_rows(T):
    """Source rows of the three best hits of each query, from any source table."""
    return _source_rows(T, 3)


def _source_rows(T, best: int | None = None):
    hits = hybrid.search_catalog(T["search_queries"], T, config="simple")
    rows = hybrid.fetch_sources(hits if best is None else hits.filter(F.col("rank") <= best), T)
    label = F.coalesce(*(F.when(F.col("source_table") == t, F.get_json_object("source_row", f"$.{c}")) for t, c in _LABELS.items()))
    return rows.select("qid", "rank", "source_table", "source_id", label.alias("label"))
