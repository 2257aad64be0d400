"""SQL (DuckDB dialect) that every registered query must agree with.

Statements are assembled from named common table expressions; each function
adds the expressions of one building block to a script and names its result.
"""

from __future__ import annotations

from ..functions.text import ENGLISH_STOP_WORDS, TOKEN_SPLIT
from ..operators import ivf, lexical
from ..operators.metrics import CUTOFFS, PLACES
from ..operators.quantize import INT8_LEVELS, PQ_BITS, PQ_BLOCKS, PQ_ROUNDS
from ..plans.experiments import METRICS, SEEDED_TRIALS
from ..plans.retrievers import METHODS
from .queries import CELLS, NEAR, PROBES, RERANK_FACTOR, TERM_K, VECTOR_K

DIMS = 64


def _words(text: str) -> str:
    return f"[t for t in regexp_split_to_array(lower({text}), '{TOKEN_SPLIT}') if t <> '']"


def _singular(term: str) -> str:
    """The rules of ``plural_stem``."""
    def ends(*suffixes: str) -> str:
        return "(" + " OR ".join(f"ends_with({term}, '{s}')" for s in suffixes) + ")"

    return f"""CASE WHEN {ends('ies')} AND NOT {ends('eies', 'aies')} THEN substr({term}, 1, length({term}) - 3) || 'y'
        WHEN {ends('es')} AND NOT {ends('aes', 'ees', 'oes')} THEN substr({term}, 1, length({term}) - 1)
        WHEN {ends('s')} AND NOT {ends('us', 'ss')} AND length({term}) > 1 THEN substr({term}, 1, length({term}) - 1) ELSE {term} END"""


class Script:
    """An ordered set of common table expressions and a final SELECT."""

    def __init__(self):
        self.parts: dict[str, str] = {}

    def add(self, name: str, sql: str) -> str:
        self.parts.setdefault(name, sql)
        return name

    def select(self, sql: str) -> str:
        head = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in self.parts.items())
        return f"WITH {head}\n{sql}" if head else sql

    # -- tables

    def corpus(self):
        return self.add("corpus", "SELECT doc_id, CASE WHEN source <> 'src0' THEN source END AS title, text FROM documents")

    def contents(self):
        self.corpus()
        return self.add("contents_rows", "SELECT doc_id, coalesce(title, '') || ' ' || coalesce(text, '') AS contents FROM corpus")

    def q_text(self):
        return self.add("q_text", "SELECT item_id AS qid, text FROM benchmark")

    def qrels(self):
        self.q_text()
        phrase = "' ' || array_to_string({}, ' ') || ' '"
        self.add("doc_phrase", f"SELECT doc_id, {phrase.format(_words('text'))} AS p FROM documents")
        self.add("q_phrase", f"SELECT qid, {phrase.format(_words('text'))} AS p FROM q_text")
        return self.add("qrels", """SELECT q.qid, d.doc_id, (1 + coalesce(l.quality, 0))::INT AS rel
            FROM q_phrase q JOIN doc_phrase d ON contains(d.p, q.p) LEFT JOIN labels l ON l.doc_id = d.doc_id""")

    # -- terms

    def lexical(self, p="t", titled=False):
        """Postings, frequencies and statistics; ``p`` keeps corpora apart, and ``stems`` is the one of singulars."""
        if titled:
            self.contents()
        source = "(SELECT doc_id, contents AS text FROM contents_rows)" if titled else "documents"
        self.q_text()
        tokens = f"SELECT doc_id, unnest({_words('text')}) AS term FROM {source}"
        self.add(f"{p}_tokens", f"SELECT doc_id, {_singular('term')} AS term FROM ({tokens})" if p == "stems" else tokens)
        self.add(f"{p}_counts", f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM {p}_tokens GROUP BY ALL")
        self.add(f"{p}_postings", f"SELECT doc_id, (sum(tf) OVER (PARTITION BY doc_id))::BIGINT AS dl, term, tf FROM {p}_counts")
        self.add(f"{p}_stats", f"""SELECT count(*)::BIGINT AS n, avg(dl) AS avgdl, sum(dl)::BIGINT AS total
            FROM (SELECT doc_id, max(dl) AS dl FROM {p}_postings GROUP BY 1)""")
        self.add(f"{p}_df", f"SELECT term, count(*)::BIGINT AS df FROM {p}_postings GROUP BY 1")
        self.query_terms()
        return p

    def query_terms(self):
        self.q_text()
        return self.add("query_terms", f"""SELECT qid, term, count(*)::BIGINT AS qtf
            FROM (SELECT qid, unnest({_words('text')}) AS term FROM q_text) GROUP BY ALL""")

    def bm25(self, p="t", titled=False):
        self.lexical(p, titled)
        asked = "query_terms"
        if p == "stems":
            asked = self.add("query_stems", f"SELECT qid, {_singular('term')} AS term, sum(qtf)::BIGINT AS qtf FROM query_terms GROUP BY ALL")
        return self.add(f"{p}_bm25", f"""SELECT qid, p.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
                * tf / (tf + {lexical.K1}::DOUBLE * (1::DOUBLE - {lexical.B}::DOUBLE + {lexical.B}::DOUBLE * dl / avgdl))), 6) AS score
            FROM {asked} JOIN {p}_postings p USING (term) JOIN {p}_df USING (term) CROSS JOIN {p}_stats GROUP BY ALL""")

    def impacts(self, p="t", titled=False):
        self.lexical(p, titled)
        self.add(f"{p}_impacts", f"SELECT doc_id, term, round(100 * ln(1 + tf::DOUBLE))::INT AS weight FROM {p}_postings")
        self.add("query_impacts", "SELECT qid, term, round(100 * ln(1 + qtf::DOUBLE))::INT AS weight FROM query_terms")
        return self.add(f"{p}_impact", f"""SELECT qid, doc_id, sum(q.weight::BIGINT * d.weight)::BIGINT AS score
            FROM query_impacts q JOIN {p}_impacts d USING (term) GROUP BY ALL""")

    def top(self, scores, k, name=None):
        return self.add(name or f"{scores}_top{k}", f"""SELECT qid, doc_id, score, rank::INT AS rank FROM (SELECT *,
            row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {scores}) WHERE rank <= {k}""")

    def bm25_run(self, k=TERM_K):
        return self.top(self.bm25(), k)

    # -- vectors

    def embedding_vectors(self):
        self.add("v", "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vector FROM embeddings")
        self.add("v_q", "SELECT doc_id AS qid, vector FROM v")
        return "v"

    def encoded(self, name, source, key):
        """The stand-in encoder: term counts in md5 buckets, unit length, as FLOAT."""
        hashed = f"SELECT {key}, (('0x' || substr(md5(term), 1, 4))::INT % {DIMS}) AS dim FROM (SELECT {key}, unnest({_words('text')}) AS term FROM {source})"
        self.add(f"{name}_counts", f"SELECT {key}, dim, count(*)::DOUBLE AS x FROM ({hashed}) GROUP BY ALL")
        self.add(f"{name}_rows", f"""SELECT {key}, dim::INT AS dim, (CASE WHEN norm > 0 THEN x / norm ELSE x END)::FLOAT::DOUBLE AS val FROM (
            SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {key})) AS norm FROM (
              SELECT s.{key}, d.dim, coalesce(c.x, 0) AS x
              FROM {source} s CROSS JOIN (SELECT unnest(range({DIMS})) AS dim) d
              LEFT JOIN {name}_counts c ON c.{key} = s.{key} AND c.dim = d.dim))""")
        return self.add(name, f"SELECT {key}, list(val ORDER BY dim) AS vector FROM {name}_rows GROUP BY {key}")

    def encoded_corpus(self):
        return self.encoded("e", "documents", "doc_id")

    def encoded_queries(self):
        self.q_text()
        return self.encoded("e_q", "q_text", "qid")

    def flat(self, v, other=True):
        """All inner products; ``other`` leaves out a vector paired with itself."""
        where = "WHERE doc_id <> qid" if other else ""
        return self.add(f"{v}_flat_{other}".lower(), f"""SELECT qid, doc_id, round(list_dot_product(q.vector, d.vector), 6) AS score
            FROM {v}_q q CROSS JOIN {v} d {where}""")

    def int8(self, v):
        self.add(f"{v}_range", f"SELECT min(list_min(vector)) AS lo, max(list_max(vector)) AS hi FROM {v}")
        self.add(f"{v}_int8", f"SELECT doc_id, [round((x - lo) / (hi - lo) * {INT8_LEVELS}) for x in vector] AS codes FROM {v} CROSS JOIN {v}_range")
        return self.add(f"{v}_int8_vectors", f"""SELECT doc_id, [lo + c * ((hi - lo) / {INT8_LEVELS}) for c in codes] AS vector
            FROM {v}_int8 CROSS JOIN {v}_range""")

    @staticmethod
    def _distance(a, b):
        return f"round(list_dot_product({a}, {a}) + list_dot_product({b}, {b}) - 2 * list_dot_product({a}, {b}), 6)"

    def cells(self, v, trial=0):
        """Lloyd rounds from the trial's seeds; the centres are ``<p>_c<rounds>``."""
        p = f"{v}_ivf{trial}"
        self.add(f"{p}_c0", f"""SELECT (row_number() OVER (ORDER BY md5(doc_id || '-{trial}')) - 1)::INT AS cell, vector AS c
            FROM (SELECT doc_id, vector FROM {v} ORDER BY md5(doc_id || '-{trial}') LIMIT {CELLS})""")
        for i in range(ivf.ROUNDS + 1):
            self.add(f"{p}_a{i}", f"""SELECT doc_id, vector, best.cell AS cell FROM (
                SELECT d.doc_id, any_value(d.vector) AS vector, min({{'d': {self._distance('d.vector', 'c.c')}, 'cell': c.cell}}) AS best
                FROM {v} d CROSS JOIN {p}_c{i} c GROUP BY d.doc_id)""")
            if i == ivf.ROUNDS:
                break
            self.add(f"{p}_m{i}", f"""SELECT cell, list(x ORDER BY dim) AS c FROM (
                SELECT cell, dim, round(avg(x), 6) AS x FROM (
                  SELECT cell, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM {p}_a{i}) GROUP BY cell, dim) GROUP BY cell""")
            self.add(f"{p}_c{i + 1}", f"SELECT o.cell, coalesce(m.c, o.c) AS c FROM {p}_c{i} o LEFT JOIN {p}_m{i} m USING (cell)")
        return f"{p}_a{ivf.ROUNDS}"

    def cell_scores(self, v, trial=0, other=True, stored=None):
        """Scores in the probed cells; ``stored`` names decoded vectors to score instead."""
        assigned = self.cells(v, trial)
        centres = f"{v}_ivf{trial}_c{ivf.ROUNDS}"
        probes = self.add(f"{v}_ivf{trial}_probes", f"""SELECT qid, cell FROM (SELECT q.qid, c.cell, row_number() OVER (
                PARTITION BY q.qid ORDER BY {self._distance('q.vector', 'c.c')}, c.cell) AS r
            FROM {v}_q q CROSS JOIN {centres} c) WHERE r <= {PROBES}""")
        rows = assigned
        if stored:
            rows = f"(SELECT a.cell, s.doc_id, s.vector FROM {assigned} a JOIN {stored} s USING (doc_id))"
        where = "WHERE d.doc_id <> p.qid" if other else ""
        return self.add(f"{v}_ivf{trial}_{stored or 'plain'}_scores", f"""SELECT p.qid, d.doc_id, round(list_dot_product(q.vector, d.vector), 6) AS score
            FROM {probes} p JOIN {v}_q q USING (qid) JOIN {rows} d ON d.cell = p.cell {where}""")

    def pq(self, v):
        width = DIMS // PQ_BLOCKS
        self.add(f"{v}_blocks", f"""SELECT doc_id, block::INT AS block, list_slice(vector, block * {width} + 1, (block + 1) * {width}) AS x
            FROM {v} CROSS JOIN (SELECT unnest(range({PQ_BLOCKS})) AS block)""")
        self.add(f"{v}_b0", f"""SELECT block, code::INT AS code, x AS c FROM (
            SELECT block, x, row_number() OVER (PARTITION BY block ORDER BY md5(doc_id || '-0')) - 1 AS code FROM {v}_blocks) WHERE code < {2 ** PQ_BITS}""")
        for i in range(PQ_ROUNDS + 1):
            self.add(f"{v}_p{i}", f"""SELECT doc_id, block, x, best.code AS code FROM (
                SELECT d.doc_id, d.block, any_value(d.x) AS x, min({{'d': {self._distance('d.x', 'c.c')}, 'code': c.code}}) AS best
                FROM {v}_blocks d JOIN {v}_b{i} c USING (block) GROUP BY d.doc_id, d.block)""")
            if i == PQ_ROUNDS:
                break
            self.add(f"{v}_n{i}", f"""SELECT block, code, list(y ORDER BY dim) AS c FROM (
                SELECT block, code, dim, round(avg(y), 6) AS y FROM (
                  SELECT block, code, unnest(x) AS y, generate_subscripts(x, 1) AS dim FROM {v}_p{i}) GROUP BY ALL) GROUP BY block, code""")
            self.add(f"{v}_b{i + 1}", f"SELECT o.block, o.code, coalesce(m.c, o.c) AS c FROM {v}_b{i} o LEFT JOIN {v}_n{i} m USING (block, code)")
        return self.add(f"{v}_pq_vectors", f"""SELECT doc_id, flatten(list(c ORDER BY block)) AS vector
            FROM {v}_p{PQ_ROUNDS} JOIN {v}_b{PQ_ROUNDS} USING (block, code) GROUP BY doc_id""")

    def decoded_run(self, v, decoded, k, other=True):
        where = "WHERE doc_id <> qid" if other else ""
        scores = self.add(f"{decoded}_scores", f"""SELECT qid, doc_id, round(list_dot_product(q.vector, d.vector), 6) AS score
            FROM {v}_q q CROSS JOIN {decoded} d {where}""")
        return self.top(scores, k)

    # -- metrics

    def per_query(self, run, qrels, ks=CUTOFFS, name="pq", identical=False):
        """Metrics of each judged query; queries absent from the run have NULL ``found``."""
        cut = ", ".join(map(str, ks))
        self.add(f"{name}_ks", f"SELECT unnest([{cut}]) AS k")
        self.add(f"{name}_ideal", f"""SELECT qid, k::INT AS k, coalesce(sum(rel / log2(i + 1)) FILTER (WHERE i <= k AND rel > 0), 0) AS idcg,
                count(*) FILTER (WHERE rel > 0) AS num_rel
            FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM {qrels}), {name}_ks GROUP BY ALL""")
        keep = "WHERE qid <> doc_id" if identical else ""
        self.add(f"{name}_reranked", f"SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {run} {keep}")
        self.add(f"{name}_judged", f"SELECT r.qid, r.rank, coalesce(j.rel, 0) AS rel FROM {name}_reranked r LEFT JOIN {qrels} j USING (qid, doc_id)")
        self.add(f"{name}_running", f"SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY qid ORDER BY rank) / rank AS prec FROM {name}_judged")
        return self.add(name, f"""SELECT i.qid, i.k, count(r.rank) > 0 AS found,
                CASE WHEN idcg > 0 THEN coalesce(sum(rel / log2(rank + 1)) FILTER (WHERE rank <= k), 0) / idcg ELSE 0 END AS ndcg,
                CASE WHEN num_rel > 0 THEN coalesce(sum(prec) FILTER (WHERE rel > 0 AND rank <= k), 0) / num_rel ELSE 0 END AS ap,
                CASE WHEN num_rel > 0 THEN count(*) FILTER (WHERE rel > 0 AND rank <= k) / num_rel ELSE 0 END AS recall,
                count(*) FILTER (WHERE rel > 0 AND rank <= k) / k AS prec
            FROM {name}_ideal i LEFT JOIN {name}_running r USING (qid) GROUP BY i.qid, i.k, idcg, num_rel""")

    def means(self, per_query, where="WHERE found"):
        return self.add(f"{per_query}_means", f"""SELECT k, count(*)::BIGINT AS num_queries, round_even(avg(ndcg), {PLACES}) AS ndcg,
            round_even(avg(ap), {PLACES}) AS map, round_even(avg(recall), {PLACES}) AS recall, round_even(avg(prec), {PLACES}) AS prec
            FROM {per_query} {where} GROUP BY k""")

    def record(self, run, dataset, method, trial=0):
        """A record of one run: counts and all metrics, one row."""
        name = f"rec_{dataset}_{method}_{trial}"
        means = self.means(self.per_query(run, self.qrels(), name=f"{name}_pq", identical=True))
        wide = ", ".join(f"coalesce(max({column}) FILTER (WHERE k = {k}), 0) AS \"{label}@{k}\""
                         for column, label in METRICS.items() for k in CUTOFFS)
        return self.add(name, f"""SELECT '{dataset}' AS dataset, '{method}' AS method, {trial}::INT AS trial,
            (SELECT count(*) FROM documents) AS num_docs, (SELECT count(*) FROM benchmark) AS num_queries, {wide} FROM {means}""")

    def method_run(self, method, trial, k):
        """The run of a named method over the documents without titles."""
        if method == "bm25":
            return self.top(self.bm25(), k)
        if method == "splade":
            return self.top(self.impacts(), k)
        self.encoded_corpus(), self.encoded_queries()
        if method == "flat":
            return self.top(self.flat("e", False), k)
        if method == "flat_quantized":
            return self.decoded_run("e", self.int8("e"), k, False)
        stored = self.int8("e") if method == "hnsw_quantized" else None
        return self.top(self.cell_scores("e", trial, False, stored), k)

    def term_records(self):
        rows = []
        for dataset, p, titled in (("plain", "t", False), ("titled", "c", True)):
            rows.append(self.record(self.top(self.bm25(p, titled), TERM_K), dataset, "bm25"))
            rows.append(self.record(self.top(self.impacts(p, titled), TERM_K), dataset, "splade"))
        return self.add("records", " UNION ALL ".join(f"SELECT * FROM {r}" for r in rows))


def _elements(table: str, key: str) -> str:
    return f"SELECT {key}, (dim - 1)::INT AS dim, round(val, 6) AS val FROM (SELECT {key}, unnest(vector) AS val, generate_subscripts(vector, 1) AS dim FROM {table})"


def _run(script: Script, run: str) -> str:
    return script.select(f"SELECT qid, doc_id, score, rank FROM {run}")


def _trials(script: Script) -> str:
    v = script.embedding_vectors()
    exact = script.top(script.flat(v), VECTOR_K)
    judged = script.add("near", f"SELECT qid, doc_id, 1 AS rel FROM {exact}")
    parts = []
    for t in range(SEEDED_TRIALS):
        run = script.top(script.cell_scores(v, t), VECTOR_K)
        means = script.means(script.per_query(run, judged, (NEAR,), f"trial{t}", True))
        parts.append(f"SELECT {t}::INT AS trial, k, num_queries, recall, ndcg FROM {means}")
    return script.add("trials", " UNION ALL ".join(parts))


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    s = Script(); s.corpus()
    sql["corpus_source"] = s.select("SELECT doc_id::VARCHAR AS doc_id, title, text FROM corpus")
    s = Script(); s.qrels()
    sql["queries_source"] = s.select("SELECT qid::VARCHAR AS qid, text FROM q_text WHERE qid IN (SELECT qid FROM qrels)")
    sql["qrels_source"] = s.select("SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, rel FROM qrels")
    sql |= {f"{table}_format": sql[f"{table}_source"] for table in ("corpus", "queries", "qrels")}
    s = Script(); s.contents()
    sql["contents_sink"] = sql["contents"] = s.select("SELECT doc_id, contents FROM contents_rows")
    s = Script(); v = s.embedding_vectors()
    sql["vectors_sink"] = s.select(_elements(v, "doc_id"))
    s = Script(); s.encoded_corpus()
    sql["embedding_cache"] = sql["encode_corpus"] = s.select("SELECT doc_id, dim, round(val, 6) AS val FROM e_rows")
    s = Script(); s.encoded_queries()
    sql["encode_queries"] = s.select("SELECT qid, dim, round(val, 6) AS val FROM e_q_rows")

    s = Script(); p = s.lexical()
    stops = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
    sql["tokens"] = s.select(f"SELECT doc_id, term FROM {p}_tokens")
    sql["tokens_stopped"] = s.select(f"SELECT doc_id, term FROM {p}_tokens WHERE term NOT IN ({stops})")
    sql["postings"] = s.select(f"SELECT doc_id, dl, term, tf FROM {p}_postings")
    sql["doc_freq"] = s.select(f"SELECT term, df FROM {p}_df")
    sql["corpus_stats"] = s.select(f"SELECT n, round(avgdl, 6) AS avgdl, total FROM {p}_stats")
    sql["term_matches"] = s.select(f"SELECT qid, doc_id, term, qtf, tf FROM query_terms JOIN {p}_postings USING (term)")
    s = Script(); scores = s.bm25()
    sql["bm25_scores"] = s.select(f"SELECT qid, doc_id, score FROM {scores}")
    s = Script()
    sql["bm25_topk"] = _run(s, s.bm25_run())
    s = Script(); s.lexical()
    sql["stems"] = s.select(f"SELECT DISTINCT term, {_singular('term')} AS stem FROM t_tokens")
    s = Script(); s.lexical("stems")
    sql["stemmed_postings"] = s.select("SELECT doc_id, dl, term, tf FROM stems_postings")
    s = Script()
    sql["bm25_stemmed_topk"] = _run(s, s.top(s.bm25("stems"), TERM_K))
    s = Script(); near = s.bm25_run(NEAR); scores = s.impacts()
    sql["impact_candidates"] = s.select(f"SELECT qid, doc_id, i.score FROM {scores} i JOIN {near} n USING (qid, doc_id)")
    s = Script(); scores = s.impacts()
    sql["impact_source"] = sql["quantize_impacts"] = s.select("SELECT doc_id, term, weight FROM t_impacts")
    sql["impact_scores"] = s.select(f"SELECT qid, doc_id, score FROM {scores}")
    sql["impact_topk"] = _run(s, s.top(scores, TERM_K))
    s = Script(); s.impacts()
    signed = s.add("signed", """SELECT qid, doc_id, sum((CASE WHEN length(term) % 2 = 1 THEN -q.weight ELSE q.weight END)::BIGINT
            * (CASE WHEN (length(term) + doc_id) % 2 = 1 THEN -d.weight ELSE d.weight END))::BIGINT AS score
        FROM query_impacts q JOIN t_impacts d USING (term) GROUP BY ALL""")
    sql["impact_topk_signed"] = sql["impact_topk_chunked"] = _run(s, s.top(signed, TERM_K))
    s = Script(); scores = s.impacts()
    named = s.add("named", f"SELECT qid, 'd' || doc_id AS doc_id, score FROM {scores}")
    sql["impact_topk_string_ids"] = _run(s, s.top(named, TERM_K))
    s = Script(); near = s.top(s.impacts(), NEAR); scores = s.bm25()
    sql["bm25_candidates"] = s.select(f"SELECT qid, doc_id, b.score FROM {scores} b JOIN {near} n USING (qid, doc_id)")
    s = Script(); s.query_terms()
    sql["encode_query_impacts"] = s.select("SELECT qid, term, round(ln(1 + qtf::DOUBLE), 6) AS weight FROM query_terms")

    s = Script()
    s.add("stretched", "SELECT vec_id AS doc_id, [x * label for x in embedding::DOUBLE[]] AS w FROM embeddings")
    s.add("unit", """SELECT doc_id, [(CASE WHEN len > 0 THEN x / len ELSE x END)::FLOAT::DOUBLE for x in w] AS vector
        FROM (SELECT doc_id, w, sqrt(list_dot_product(w, w)) AS len FROM stretched)""")
    sql["l2_normalize"] = s.select(_elements("unit", "doc_id"))
    s = Script(); v = s.embedding_vectors(); flat = s.top(s.flat(v), VECTOR_K)
    # Other ways to the same exact run.
    sql["flat_topk"] = sql["ball_topk"] = sql["two_level_topk"] = _run(s, flat)
    sql["inner_product"] = s.select(f"SELECT qid, doc_id, score FROM {flat}")
    sql["hits_to_run"] = s.select(f"""SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INT AS rank
        FROM (SELECT qid, 'v' || doc_id AS doc_id, score FROM {flat} WHERE score >= 0.3)""")
    s = Script(); v = s.embedding_vectors(); own = s.top(s.flat(v, False), VECTOR_K + 1)
    sql["drop_identical"] = s.select(f"""SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INT AS rank
        FROM {own} WHERE qid <> doc_id""")
    s = Script(); v = s.embedding_vectors(); decoded = s.int8(v)
    sql["int8_codes"] = s.select(f"SELECT doc_id, (dim - 1)::INT AS dim, code::INT AS code FROM (SELECT doc_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS dim FROM {v}_int8)")
    sql["int8_topk"] = _run(s, s.decoded_run(v, decoded, VECTOR_K))
    s = Script(); v = s.embedding_vectors(); decoded = s.pq(v)
    sql["pq_codes"] = s.select(f"SELECT doc_id, block, code FROM {v}_p{PQ_ROUNDS}")
    sql["pq_topk"] = _run(s, s.decoded_run(v, decoded, VECTOR_K))
    s = Script(); v = s.embedding_vectors(); near = s.decoded_run(v, s.pq(v), VECTOR_K * RERANK_FACTOR)
    exact = s.add("reranked", f"""SELECT n.qid, n.doc_id, round(list_dot_product(q.vector, d.vector), 6) AS score
        FROM {near} n JOIN {v}_q q USING (qid) JOIN {v} d ON d.doc_id = n.doc_id""")
    sql["pq_rerank"] = _run(s, s.top(exact, VECTOR_K))
    s = Script(); v = s.embedding_vectors(); assigned = s.cells(v)
    sql["ivf_assign"] = s.select(f"SELECT doc_id, cell FROM {assigned}")
    for key, compress in (("ivf_topk", None), ("ivf_int8_topk", "int8"), ("ivf_pq_topk", "pq")):
        s = Script(); v = s.embedding_vectors()
        stored = getattr(s, compress)(v) if compress else None
        sql[key] = _run(s, s.top(s.cell_scores(v, stored=stored), VECTOR_K))
    s = Script(); _trials(s)
    sql["ivf_trials"] = s.select("SELECT trial, k, num_queries, recall, ndcg FROM trials")
    sql["trial_summary"] = s.select("""SELECT 'embeddings' AS dataset, 'hnsw' AS method, count(*)::BIGINT AS trials,
        round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std FROM trials""")

    s = Script(); run = s.bm25_run()
    s.add("first_copy", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
    sql["dedupe_hits"] = s.select(f"SELECT qid, first_id AS doc_id, max_by(score, rank) AS score FROM {run} JOIN first_copy USING (doc_id) GROUP BY ALL")
    s = Script(); bm25 = s.bm25_run(); learned = s.top(s.impacts(), TERM_K)
    sql["run_union"] = s.select(f"""SELECT 'bm25' AS method, qid, doc_id, score, rank FROM {bm25}
        UNION ALL SELECT 'splade', qid, doc_id, score::DOUBLE, rank FROM {learned}""")

    s = Script(); run, qrels = s.bm25_run(), s.qrels()
    sql["judged_run"] = s.select(f"SELECT qid, doc_id, score, rank, coalesce(rel, 0)::INT AS rel FROM {run} LEFT JOIN {qrels} USING (qid, doc_id)")
    per_query = s.per_query(run, qrels)
    sql["ideal_dcg"] = s.select("SELECT qid, k, round(idcg, 6) AS idcg, num_rel FROM pq_ideal")
    sql["ndcg_per_query"] = s.select(f"""SELECT qid, k, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap, round(recall, 6) AS recall,
        round(prec, 6) AS prec FROM {per_query} WHERE found""")
    means = s.means(per_query)
    for key, column in (("ndcg", "ndcg"), ("map_at_k", "map"), ("recall_at_k", "recall"), ("precision_at_k", "prec")):
        sql[key] = s.select(f"SELECT k, num_queries, {column} FROM {means}")
    s = Script(); means = s.means(s.per_query(s.bm25_run(), s.qrels(), identical=True), "")
    sql["metrics_all_judged"] = s.select(f"SELECT k, num_queries, ndcg, map, recall, prec FROM {means}")

    sql["experiment_grid"] = """SELECT lang AS dataset, method, trial::INT AS trial, num_docs
        FROM (SELECT lang, count(*) AS num_docs FROM documents GROUP BY 1)
        CROSS JOIN (SELECT 'bm25' AS method, 0 AS trial UNION ALL SELECT 'splade', 0 UNION ALL SELECT 'hnsw', unnest(range(5)))"""
    sql["unknown_methods"] = """SELECT method, count(*) AS requests FROM (
        SELECT 'bm25' || CASE WHEN lang = 'en' THEN '' ELSE '_' || lang END AS method FROM documents)
        WHERE method NOT IN ('bm25', 'splade', 'flat', 'flat_quantized', 'hnsw', 'hnsw_quantized') GROUP BY 1"""
    s = Script(); record = s.record(s.bm25_run(), "plain", "bm25")
    sql["run_record"] = s.select(f"SELECT * FROM {record}")
    s = Script()
    parts = [f"SELECT '{m}' AS method, qid, doc_id, score::DOUBLE AS score, rank FROM {s.method_run(m, 0, VECTOR_K)}" for m in METHODS]
    sql["all_methods_run"] = s.select(" UNION ALL ".join(parts))
    s = Script()
    parts = [f"SELECT * FROM {s.record(s.method_run(m, t, TERM_K), 'plain', m, t)}"
             for m in METHODS for t in range(SEEDED_TRIALS if "hnsw" in m else 1)]
    sql["experiment_sweep"] = s.select(" UNION ALL ".join(parts))

    s = Script(); s.term_records()
    sql["results_csv"] = s.select("SELECT * FROM records")
    stamps = "(SELECT unnest(['20260101_000000', '20260102_000000']) AS run_ts)"
    sql["results_json"] = s.select(f'SELECT run_ts, dataset, method, trial, num_docs, num_queries, "NDCG@10" FROM records CROSS JOIN {stamps}')
    sql["summary_table"] = s.select('SELECT dataset, method, trial, round("NDCG@10", 5) AS ndcg10 FROM records')
    sql["method_pivot"] = s.select("""SELECT dataset, max("NDCG@10") FILTER (WHERE method = 'bm25') AS bm25,
        max("NDCG@10") FILTER (WHERE method = 'splade') AS splade FROM records GROUP BY dataset""")
    sql["reproduction_error"] = s.select("""SELECT 'documents' AS dataset, method, measured, published,
        round_even(measured - published, 4) AS diff, round_even(abs(measured - published) / published * 100, 4) AS abs_error_pct
        FROM (SELECT method, max("NDCG@10") FILTER (WHERE dataset = 'titled') AS measured,
              round_even(max("NDCG@10") FILTER (WHERE dataset = 'plain'), 3) AS published FROM records GROUP BY method)""")
    return sql
