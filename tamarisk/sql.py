"""DuckDB SQL for the registered queries, written against the semantics, not derived from the plans."""

from __future__ import annotations

from .functions.turkish import FOLD_FROM, FOLD_TO, SOFTENED, STOPWORDS, SUFFIXES, VOWELS

WORD = "[0-9a-zçğıöşü]+(?:[''’][0-9a-zçğıöşü]+)*"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def fold(t: str) -> str:
    return f"lower(translate({t}, '{FOLD_FROM}', '{FOLD_TO}'))"


def tokens(t: str) -> str:
    return f"regexp_extract_all({fold(f'coalesce({t}, {chr(39) * 2})')}, '{WORD}')"


def _strip(prev: str, suffixes) -> str:
    rest = "left(w, length(w) - length(suf))"
    soft = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SOFTENED.items())
    return f"""(SELECT word, CASE WHEN suf IS NULL THEN w ELSE left({rest}, length({rest}) - 1) || CASE right({rest}, 1) {soft} ELSE right({rest}, 1) END END AS w
      FROM (SELECT word, w, list_filter({_list(suffixes)}, lambda s: suffix(w, s) AND length(w) - length(s) >= 4
            AND regexp_matches(left(w, length(w) - length(s)), '[{VOWELS}]'))[1] AS suf FROM {prev}))"""


def stems(p: str, source: str) -> str:
    """CTEs that end in {p}stems (word, stem) for the words of a CTE."""
    long = [s for s in SUFFIXES if len(s) > 1]
    steps = f"{p}s0 AS (SELECT DISTINCT word, word AS w FROM {source}), {p}s1 AS {_strip(p + 's0', SUFFIXES)}, "
    steps += ", ".join(f"{p}s{i} AS {_strip(f'{p}s{i - 1}', long)}" for i in (2, 3, 4))
    return steps + f""", {p}stems AS (SELECT word, CASE WHEN regexp_matches(word, '[''’]') THEN {fold("regexp_replace(word, '[''’].*$', '')")}
        WHEN length(word) <= 4 THEN word ELSE w END AS stem FROM {p}s4)"""


def expanded(p: str, source: str, key: str, text: str) -> str:
    """CTEs that end in {p}x (id, pos, k, term): expanded tokens in order."""
    return f"""{p}l AS (SELECT {key} AS id, {tokens(text)} AS l FROM {source}),
      {p}t AS (SELECT id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM {p}l), {stems(p, p + "t")},
      {p}x AS (SELECT id, pos, 0 AS k, word AS term FROM {p}t
        UNION ALL SELECT id, pos, 1, stem FROM {p}t JOIN {p}stems USING (word) WHERE stem <> word AND stem <> '')"""


CONTENT = f"length(term) > 1 AND NOT list_contains({_list(STOPWORDS)}, term)"
D = expanded("d", "documents", "doc_id", "text")
Q = expanded("q", "benchmark", "item_id", "text")
BM25 = f"""{D}, {Q},
  tf AS (SELECT id, term, count(*) AS tf FROM dx GROUP BY ALL),
  dlen AS (SELECT doc_id AS id, coalesce(n, 0) AS dl FROM documents LEFT JOIN (SELECT id AS doc_id, sum(tf) AS n FROM tf GROUP BY 1) USING (doc_id)),
  corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dlen),
  idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
  qf AS (SELECT id AS qid, term, count(*) AS qf FROM qx GROUP BY ALL),
  bm AS (SELECT qid, tf.id AS id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM corpus)))) AS raw
         FROM qf JOIN tf USING (term) JOIN idf USING (term) JOIN dlen ON dlen.id = tf.id GROUP BY ALL),
  lex AS (SELECT qid, id, round(raw, 6) AS score FROM bm)"""


def features(p: str, source: str, key: str, text: str) -> str:
    """CTEs that end in {p}v (id, bucket, weight): sparse hashed embeddings."""
    accents = f"translate({fold(f'coalesce({text}, {chr(39) * 2})')}, 'çğöşüáàâäéèêëíìîïóòôúùûñ', 'cgosuaaaaeeeeiiiiooouuun')"
    return f"""{p}w AS (SELECT {key} AS id, regexp_extract_all({accents}, '{WORD}') AS l FROM {source}),
      {p}u AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM {p}w),
      {p}f AS (SELECT id, 'w:' || w AS f FROM {p}u
        UNION ALL SELECT id, 'c:' || substr(w, i, 4) FROM (SELECT id, w, unnest(range(1, length(w) - 2)) AS i FROM {p}u WHERE length(w) > 5)
        UNION ALL SELECT id, 'b:' || w || '_' || nxt FROM (SELECT id, w, lead(w) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM {p}u) WHERE nxt IS NOT NULL),
      {p}c AS (SELECT id, f, md5(f) AS m, count(*) AS n FROM {p}f GROUP BY ALL),
      {p}b AS (SELECT id, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % 512 AS bucket,
               sum(CASE WHEN CAST(('0x' || substr(m, 9, 1)) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END * (1 + ln(n))) AS x FROM {p}c GROUP BY ALL),
      {p}v AS (SELECT id, bucket, CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY id)) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY id)) ELSE 0 END AS weight FROM {p}b)"""


BOTH = f"""{BM25}, {features("e", "documents", "doc_id", "text")}, {features("g", "benchmark", "item_id", "text")},
  den AS (SELECT g.id AS qid, e.id AS id, round(sum(e.weight * g.weight), 6) AS score FROM ev e JOIN gv g USING (bucket) GROUP BY ALL)"""
FUSED = f"""{BOTH},
  dr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM den WHERE score > 0),
  lr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM lex WHERE score > 0),
  fu AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.id, l.id) AS id, d.r AS dense_rank, l.r AS lex_rank,
         coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + l.r), 0) AS fused
         FROM (SELECT * FROM dr WHERE r <= 20) d FULL JOIN (SELECT * FROM lr WHERE r <= 20) l ON d.qid = l.qid AND d.id = l.id),
  fs AS (SELECT fu.*, coalesce(den.score, 0) AS d, coalesce(lex.score, 0) AS x FROM fu
         LEFT JOIN den ON den.qid = fu.qid AND den.id = fu.id LEFT JOIN lex ON lex.qid = fu.qid AND lex.id = fu.id)"""
HITS = f"""{FUSED},
  gate AS (SELECT *, greatest(d, CASE WHEN x <= 0 THEN 0 ELSE x / (x + 16) END) AS score FROM fs),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, dense_rank NULLS LAST, lex_rank NULLS LAST) AS rank
           FROM gate WHERE score >= 0.3) WHERE rank <= 4)"""
EXPECTED = """ex AS (SELECT b.item_id AS qid, 'doc' || CAST(min(d.doc_id) AS VARCHAR) AS expected
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"""
JUDGED = f"""{HITS}, {EXPECTED},
  j AS (SELECT ex.qid, expected, min(CASE WHEN 'doc' || CAST(id AS VARCHAR) = expected THEN rank END) AS rank, count(id) AS n FROM ex LEFT JOIN hits USING (qid) GROUP BY ALL),
  m AS (SELECT count(*) AS questions, count(expected) AS n_answerable,
    coalesce(avg(CASE WHEN expected IS NOT NULL THEN CAST(rank IS NOT NULL AS INT) END), 0) AS recall_at_k,
    coalesce(avg(CASE WHEN expected IS NOT NULL THEN coalesce(1.0 / rank, 0) END), 0) AS mrr,
    coalesce(avg(CASE WHEN expected IS NULL THEN CAST(n = 0 AS INT) END), 0) AS refusal_accuracy,
    avg(CAST(CASE WHEN expected IS NULL THEN n = 0 ELSE rank IS NOT NULL END AS INT)) AS overall_accuracy FROM j)"""
TOP4 = f"""{BM25}, hits AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lex WHERE score > 0) WHERE rank <= 4),
  p AS (SELECT qid, rank, 'doc' || CAST(id AS VARCHAR) AS source, text AS content FROM hits JOIN documents ON doc_id = id)"""
MARK = "chr(31)"


def cut(text: str, pattern: str, keep: str) -> str:
    return f"string_split(regexp_replace({text}, '{pattern}', '{keep}' || {MARK}, 'g'), {MARK})"


ANSWER_CUT = r"""string_split(regexp_replace(regexp_replace({t}, '([.!?…])\s+', '\1' || chr(31), 'g'), '\n+', chr(31), 'g'), chr(31))"""
ANSWER_SENTENCES = "list_filter(list_transform(" + ANSWER_CUT + ", lambda s: trim(s, ' -•' || chr(9))), lambda s: length(s) >= 25)"
QUOTE_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '([.!?…])\s+', '\1' || chr(31), 'g'), '\n\n+', chr(31), 'g'), chr(31)),
  lambda s: trim(s, ' -•*' || chr(9))), lambda s: length(s) >= 30)"""
PLAIN = r"""regexp_replace(regexp_replace({t}, '\[[^\]]*\]', '', 'g'), '[*_`#>]+', '', 'g')"""
EXTRACT = f"""{TOP4},
  qs AS (SELECT qid, rank, source, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT *, {QUOTE_SENTENCES.format(t="content")} AS l FROM p)),
  ksent AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT sentence FROM qs)), {expanded("k", "ksent", "id", "sentence")},
  kterm AS (SELECT DISTINCT sentence, term FROM kx JOIN ksent USING (id) WHERE {CONTENT}),
  qterm AS (SELECT DISTINCT id AS qid, term FROM qx WHERE {CONTENT}),
  qn AS (SELECT qid, count(*) AS n FROM qterm GROUP BY 1),
  hitn AS (SELECT s.qid, s.sentence, count(*) AS c FROM (SELECT DISTINCT qid, sentence FROM qs) s JOIN kterm USING (sentence) JOIN qterm ON qterm.qid = s.qid AND qterm.term = kterm.term GROUP BY ALL),
  es AS (SELECT qs.qid, rank, pos, qs.sentence, source, c / CAST(n AS DOUBLE) AS relevance, c / CAST(n AS DOUBLE) * (0.5 + 0.5 / rank) AS weighted
         FROM qs JOIN qn USING (qid) JOIN hitn ON hitn.qid = qs.qid AND hitn.sentence = qs.sentence WHERE c / CAST(n AS DOUBLE) >= 0.08)"""
TURNS = """a AS (SELECT conv_id * 1000 + turn AS qid, conv_id, text AS answer FROM conversations WHERE role = 'assistant'),
  us AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, 'turn' || CAST(turn AS VARCHAR) AS source, conv_id * 1000 + turn AS pid, text FROM conversations WHERE role = 'user'),
  h AS (SELECT qid, rank, source, pid, text AS passage FROM a JOIN us USING (conv_id))"""
RECORDED = """pl AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER w AS pos, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS k
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('assistant', 'user') WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, ''))),
  nu AS (SELECT row_number() OVER (ORDER BY conv_id, pos) AS qid, * FROM pl),
  a AS (SELECT qid, conv_id, turn, k, text AS answer FROM nu WHERE role = 'assistant'),
  us AS (SELECT conv_id, turn, k, 'turn' || CAST(turn AS VARCHAR) AS source, qid AS pid, text FROM nu WHERE role = 'user'),
  h AS (SELECT a.qid, a.k - us.k + 1 AS rank, source, pid, us.text AS passage FROM a JOIN us ON us.conv_id = a.conv_id AND us.k BETWEEN a.k - 3 AND a.k)"""


def audit(turns: str) -> str:
    """CTEs that end in ver (qid, pos, score, supported, best_source): answers a (qid, answer), passages us (pid, text) and hits h are given by ``turns``."""
    return f"""{turns},
  se AS (SELECT qid, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT qid, {ANSWER_SENTENCES.format(t=PLAIN.format(t="answer"))} AS l FROM a)),
  se2 AS (SELECT qid * 100000 + pos AS sid, * FROM se), {expanded("s", "se2", "sid", "sentence")},
  up AS (SELECT pid, text FROM us), {expanded("u", "up", "pid", "text")},
  sterm AS (SELECT qid, se2.pos AS pos, term, least(count(*), 2) AS n FROM sx JOIN se2 ON sid = id WHERE {CONTENT} GROUP BY ALL),
  uterm AS (SELECT DISTINCT id AS pid, term FROM ux WHERE {CONTENT}),
  hn AS (SELECT qid, count(*) AS n FROM h GROUP BY 1),
  hi AS (SELECT qid, term, ln(1 + any_value(hn.n) / (count(*) + 0.5)) AS idf FROM h JOIN uterm USING (pid) JOIN hn USING (qid) GROUP BY ALL),
  hm AS (SELECT qid, max(idf) AS top FROM hi GROUP BY 1),
  sw AS (SELECT sterm.qid, pos, sterm.term, sterm.n * coalesce(idf, top, 1.0) AS w FROM sterm LEFT JOIN hi ON hi.qid = sterm.qid AND hi.term = sterm.term LEFT JOIN hm ON hm.qid = sterm.qid),
  tot AS (SELECT qid, pos, sum(w) AS total FROM sw GROUP BY ALL),
  cov AS (SELECT sw.qid, sw.pos, h.rank, sum(w) AS covered FROM sw JOIN h ON h.qid = sw.qid JOIN uterm ON uterm.pid = h.pid AND uterm.term = sw.term GROUP BY ALL),
  sup AS (SELECT se.qid, se.pos, h.rank, h.source, coalesce(covered / total, 0) AS score FROM se JOIN h ON h.qid = se.qid
          LEFT JOIN tot ON tot.qid = se.qid AND tot.pos = se.pos LEFT JOIN cov ON cov.qid = se.qid AND cov.pos = se.pos AND cov.rank = h.rank),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY round(score, 12) DESC, rank) AS k FROM sup) WHERE k = 1),
  ver AS (SELECT se.qid, se.pos, coalesce(score, 0) AS score, coalesce(score, 0) >= 0.45 AS supported, CASE WHEN score > 0 THEN source ELSE '' END AS best_source
          FROM se LEFT JOIN best ON best.qid = se.qid AND best.pos = se.pos)"""


DIALOGUE = audit(TURNS)


def bigrams(t: str) -> str:
    w = rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
    pairs = f"list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"(SELECT CASE WHEN len(w) < 2 THEN 1.0 ELSE len(list_distinct({pairs})) / CAST(len(w) - 1 AS DOUBLE) END FROM (SELECT {w} AS w))"


def repeats(source: str, key: str, text: str) -> str:
    """CTE rp (id, sentence): the first sentence said again."""
    return rf"""rs AS (SELECT id, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM (SELECT {key} AS id, {ANSWER_SENTENCES.format(t=PLAIN.format(t=text))} AS l FROM {source})),
      rk AS (SELECT *, row_number() OVER (PARTITION BY id, lower(trim(regexp_replace(sentence, '\s+', ' ', 'g'))) ORDER BY pos) AS k FROM rs),
      rp AS (SELECT id, arg_min(sentence, pos) AS sentence FROM rk WHERE k > 1 GROUP BY id)"""


HASH = "sha256('s' || chr(0) || '' || chr(0) || text)"


def reported(turns: str) -> str:
    return f"""{audit(turns)}, {repeats("a", "qid", "answer")},
  r AS (SELECT a.qid, answer, count(ver.pos) AS n, count(*) FILTER (WHERE supported) AS good FROM a LEFT JOIN ver USING (qid) GROUP BY ALL),
  rep AS (SELECT qid, CASE WHEN n = 0 THEN 1.0 ELSE good / CAST(n AS DOUBLE) END AS score, n AS n_sentences, n - good AS n_unsupported,
          n > 0 AND ({bigrams("answer")} < 0.75 OR rp.sentence IS NOT NULL) AS degenerate FROM r LEFT JOIN rp ON rp.id = qid)"""


REPORT = reported(TURNS)
SCALED = "(VALUES (16.0), (32.0), (64.0), (128.0), (256.0), (512.0)) sc(lexical_scale)"
CELLS = f"SELECT sc.lexical_scale, si.min_similarity FROM {SCALED}, (VALUES (0.0), (0.05), (0.10), (0.15), (0.20), (0.25), (0.30), (0.35), (0.40), (0.50), (0.60)) si(min_similarity)"
CONFIDENCES = f"""SELECT DISTINCT sc.lexical_scale, greatest(d, CASE WHEN x <= 0 THEN 0 ELSE x / (x + CAST(sc.lexical_scale AS DOUBLE)) END) AS min_similarity FROM fs, {SCALED}
  UNION SELECT sc.lexical_scale, 1.0 FROM {SCALED}"""


def grid(cells: str) -> str:
    """CTEs that end in gbal, the metrics of every (lexical_scale, min_similarity) of ``cells``."""
    return f"""{FUSED}, {EXPECTED},
  g AS ({cells}),
  gh AS (SELECT * FROM (SELECT g.*, qid, id, row_number() OVER (PARTITION BY lexical_scale, min_similarity, qid ORDER BY fused DESC, dense_rank NULLS LAST, lex_rank NULLS LAST) AS rank
         FROM fs, g WHERE greatest(d, CASE WHEN x <= 0 THEN 0 ELSE x / (x + CAST(lexical_scale AS DOUBLE)) END) >= CAST(min_similarity AS DOUBLE)) WHERE rank <= 4),
  gj AS (SELECT g.lexical_scale, g.min_similarity, ex.qid, expected, count(id) AS n, coalesce(bool_or('doc' || CAST(id AS VARCHAR) = expected), false) AS hit
         FROM g CROSS JOIN ex LEFT JOIN gh ON gh.qid = ex.qid AND gh.lexical_scale = g.lexical_scale AND gh.min_similarity = g.min_similarity GROUP BY ALL),
  gm AS (SELECT CAST(lexical_scale AS DOUBLE) AS lexical_scale, CAST(min_similarity AS DOUBLE) AS min_similarity,
         coalesce(avg(CASE WHEN expected IS NOT NULL THEN CAST(hit AS INT) END), 0) AS recall,
         coalesce(avg(CASE WHEN expected IS NULL THEN CAST(n = 0 AS INT) END), 0) AS refusal,
         avg(CAST(CASE WHEN expected IS NULL THEN n = 0 ELSE hit END AS INT)) AS overall FROM gj GROUP BY ALL),
  gbal AS (SELECT *, CASE WHEN recall + refusal = 0 THEN 0 ELSE 2 * recall * refusal / (recall + refusal) END AS balanced FROM gm)"""


GRID = grid(CELLS)
DISTINCT_TEXT = "sha256(coalesce(source, '') || chr(0) || '' || chr(0) || coalesce(text, ''))"
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{WS}+', ''), '{WS}+$', '')"


def packed(source: str, size: int, overlap: int) -> str:
    """CTEs that end in ch (id, sec, n, content): the texts of {source} (id, sec, body) in pieces, packed by a recursion over the pieces of each."""
    room = "length(held) + 2 + length(u)"
    end = f"right(held, {overlap})"
    rest = f"substr({end}, strpos({end}, ' ') + 1)"
    tail = f"CASE WHEN length(held) <= {overlap} THEN held WHEN strpos({end}, ' ') > 0 AND {rest} <> '' THEN {stripped(rest)} ELSE {stripped(end)} END"
    return rf"""pa AS (SELECT id, sec, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT id, sec, string_split(regexp_replace(body, '\n({WS}+)?\n', chr(1), 'g'), chr(1)) AS l FROM {source})),
  pb AS (SELECT id, sec, i, {stripped("p")} AS p FROM pa),
  pc AS (SELECT id, sec, i, CASE WHEN length(p) <= {size} THEN [p] ELSE string_split(regexp_replace(p, '([.!?…])["''”’)\]]*{WS}+', '\1' || chr(1), 'g'), chr(1)) END AS l FROM pb WHERE p <> ''),
  pd AS (SELECT id, sec, i, j, regexp_extract_all({stripped("x")}, '(?s).{{1,{size}}}') AS l FROM (SELECT id, sec, i, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM pc)),
  pe AS (SELECT id, sec, i, j, unnest(l) AS u, generate_subscripts(l, 1) AS k FROM pd),
  pn AS (SELECT id, sec, u, row_number() OVER (PARTITION BY id, sec ORDER BY i, j, k) AS n FROM pe),
  pk AS (SELECT id, sec, n, u AS held, CAST(NULL AS VARCHAR) AS out FROM pn WHERE n = 1
    UNION ALL SELECT id, sec, pn.n, CASE WHEN {room} <= {size} THEN held || chr(10) || chr(10) || u WHEN ({tail}) <> '' THEN {stripped(f"({tail}) || chr(10) || chr(10) || u")} ELSE u END,
      CASE WHEN {room} > {size} THEN {stripped("held")} END FROM pk JOIN pn USING (id, sec) WHERE pn.n = pk.n + 1),
  ch AS (SELECT id, sec, n, out AS content FROM pk WHERE out <> '' UNION ALL SELECT id, sec, n + 1, content FROM (SELECT id, sec, max(n) AS n, {stripped("arg_max(held, n)")} AS content FROM pk GROUP BY ALL) WHERE content <> '')"""


HEADED = r"'^#{1,6}" + WS + r"+.*[^" + WS[1:] + WS + r"*$'"
SECTIONED = rf"""li AS (SELECT doc_id AS id, unnest(l) AS line, generate_subscripts(l, 1) AS pos, len(l) AS many FROM
    (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)) AS l FROM documents)),
  lh AS (SELECT *, regexp_matches(line, {HEADED}) AS headed FROM li WHERE pos < many OR line <> ''),
  ls AS (SELECT *, sum(CAST(headed AS INT)) OVER w AS sec, coalesce(last_value(CASE WHEN headed THEN {stripped("regexp_replace(line, '^#+', '')")} END IGNORE NULLS) OVER w, '') AS heading FROM lh WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  sb AS (SELECT id, sec, any_value(heading) AS heading, string_agg(line, chr(10) ORDER BY pos) AS body FROM ls WHERE NOT headed GROUP BY ALL)"""
DOC_WORDS = f"t AS (SELECT DISTINCT unnest({tokens('text')}) AS word FROM documents)"
ORACLES = {
    "fold_case": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "tokenize": f"SELECT doc_id, len(l) AS n, md5(array_to_string(l, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS l FROM documents)",
    "term_freq": f"WITH {D} SELECT id AS doc_id, term, count(*) AS tf FROM dx GROUP BY ALL",
    "vocab_size": f"WITH {DOC_WORDS}, {stems('v', 't')} SELECT count(*) AS vocabulary FROM (SELECT word FROM vstems UNION SELECT stem FROM vstems WHERE stem <> '')",
    "stem": f"WITH {DOC_WORDS}, {stems('v', 't')} SELECT word, stem FROM vstems",
    "last_vowel": f"""WITH {DOC_WORDS} SELECT word, nullif(regexp_extract(word, '.*([{VOWELS}])', 1), '') AS vowel,
      CASE WHEN regexp_matches(word, '[eiöü][^{VOWELS}]*$') THEN 'front' WHEN regexp_matches(word, '[aıou][^{VOWELS}]*$') THEN 'back' END AS harmony FROM t""",
    "expand_tokens": f"""WITH {D} SELECT doc_id, coalesce(n, 0) AS n, coalesce(m, md5('')) AS terms_md5 FROM documents
      LEFT JOIN (SELECT id, count(*) AS n, md5(string_agg(term, ' ' ORDER BY pos, k)) AS m FROM dx GROUP BY id) ON id = doc_id""",
    "normalize_text": f"""WITH {D} SELECT doc_id, coalesce(m, md5('')) AS normalized_md5 FROM documents
      LEFT JOIN (SELECT id, md5(string_agg(stem, ' ' ORDER BY pos)) AS m FROM dt JOIN dstems USING (word) GROUP BY id) ON id = doc_id""",
    "shares_root": f"""WITH {Q}, pr AS (SELECT id, pos, word AS a, lead(word) OVER (PARTITION BY id ORDER BY pos) AS b FROM qt)
      SELECT id AS item_id, pos - 1 AS pos, a, b, a = b OR (a = y.stem AND y.stem <> '') OR (b = x.stem AND x.stem <> '') OR (x.stem = y.stem AND x.stem <> '') AS related
      FROM pr JOIN qstems x ON x.word = a JOIN qstems y ON y.word = b""",
    "content_terms": f"WITH {D} SELECT id AS doc_id, term, count(*) AS n FROM dx WHERE {CONTENT} GROUP BY ALL",
    "sentence_split": rf"""SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id,
      list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])["''”’)\]]*\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: s <> '') AS l FROM documents)""",
    "sections": r"""WITH l(doc, line_no, line) AS (VALUES ('a', 0, 'intro'), ('a', 1, '# One'), ('a', 2, 'x'), ('a', 3, '## Two'), ('a', 4, ''), ('a', 5, 'y'), ('a', 6, '#NoHeading'), ('a', 7, 'z'),
        ('b', 0, '# Only'), ('c', 0, ''), ('c', 1, '# T ' || chr(9)), ('c', 2, 'last')),
      m AS (SELECT *, regexp_matches(line, '^#{1,6}\s+.*\S\s*$') AS is_heading FROM l),
      w AS (SELECT *, sum(CAST(is_heading AS INT)) OVER o AS section, coalesce(last_value(CASE WHEN is_heading THEN regexp_extract(line, '^#{1,6}\s+(.*\S)\s*$', 1) END IGNORE NULLS) OVER o, '') AS heading
        FROM m WINDOW o AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING))
      SELECT doc, CAST(section AS BIGINT) AS section, heading, string_agg(line, chr(10) ORDER BY line_no) AS body FROM w WHERE NOT is_heading GROUP BY ALL""",
    "content_hash": "SELECT doc_id, sha256(source || chr(0) || upper(lang) || chr(0) || text) AS content_hash FROM documents",
    "citation": """SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE source || ' > ' || lang END AS citation, length(text) + CASE WHEN lang = 'en' THEN 0 ELSE 4 END AS embedded_chars,
      length(text) + CASE WHEN lang = 'en' THEN 1 ELSE 3 END AS indexed_chars FROM documents""",
    "bm25_index": f"WITH {BM25} SELECT id AS doc_id, CAST(dl AS BIGINT) AS dl, n, round(avgdl, 6) AS avgdl FROM dlen, corpus",
    "idf": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_scores": f"WITH {BM25} SELECT qid AS item_id, id AS doc_id, score FROM lex",
    "bm25_topk": f"WITH {BM25} SELECT * FROM (SELECT qid AS item_id, id AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lex WHERE score > 0) WHERE rank <= 10",
    "saturate": f"WITH {BM25} SELECT qid AS item_id, id AS doc_id, round(CASE WHEN raw <= 0 THEN 0 ELSE raw / (raw + 16) END, 6) AS confidence FROM bm",
    "l2_norm": """SELECT vec_id, round(n, 5) AS norm, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n)))), 5) AS unit
      FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""",
    "cosine_similarity": "SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0",
    "dense_topk": """SELECT qid, rank, vec_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS rank FROM
      (SELECT q.vec_id AS qid, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 4 AND s >= 0.3""",
    "dim_check": "SELECT count(DISTINCT len(embedding)) AS widths, min(len(embedding)) AS least, max(len(embedding)) AS most FROM embeddings",
    "hash_embed_sql": f"WITH {features('g', 'benchmark', 'item_id', 'text')} SELECT id AS item_id, bucket, round(weight, 6) AS weight FROM gv",
    "matched_by_label": f"WITH {FUSED} SELECT qid AS item_id, id AS doc_id, CASE WHEN d > 0.01 AND x > 0 THEN 'ikisi' WHEN x > 0 THEN 'kelime' ELSE 'anlam' END AS matched_by FROM fs",
    "rrf_fuse": f"WITH {FUSED} SELECT qid AS item_id, id AS doc_id, coalesce(dense_rank, 0) AS dense_rank, coalesce(lex_rank, 0) AS lex_rank, round(fused, 9) AS fused FROM fu",
    "hybrid": f"""WITH {HITS} SELECT qid AS item_id, rank, id AS doc_id, round(score, 6) AS score, d AS dense_score, x AS lexical_score, round(fused, 9) AS fused_score,
      CASE WHEN d > 0.01 AND x > 0 THEN 'ikisi' WHEN x > 0 THEN 'kelime' ELSE 'anlam' END AS matched_by FROM hits""",
    "extract_scores": f"WITH {EXTRACT} SELECT qid AS item_id, rank, pos, round(relevance, 6) AS relevance, round(weighted, 6) AS weighted FROM es",
    "extract_answer": f"""WITH {EXTRACT}, e1 AS (SELECT *, row_number() OVER (PARTITION BY qid, sentence ORDER BY round(weighted, 12) DESC, rank, pos) AS a FROM es),
      e2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(weighted, 12) DESC, rank, pos) AS place FROM e1 WHERE a = 1),
      e3 AS (SELECT qid, string_agg(sentence || ' [' || source || ']', chr(10) ORDER BY place) AS answer FROM e2 WHERE place <= 3 GROUP BY qid)
      SELECT item_id, coalesce(answer, 'Bu bilgi elimdeki belgelerde yok.') AS answer FROM benchmark LEFT JOIN e3 ON qid = item_id""",
    "format_context": f"""WITH {TOP4} SELECT qid AS item_id, md5(string_agg('[' || CAST(rank AS VARCHAR) || '] Kaynak: ' || source || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM p GROUP BY qid""",
    "build_messages": f"""WITH {TOP4}, c AS (SELECT qid, string_agg('[' || CAST(rank AS VARCHAR) || '] Kaynak: ' || source || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c FROM p GROUP BY qid)
      SELECT item_id, 2 AS n, md5('BAĞLAM:' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'SORU: ' || trim(text) || chr(10) || chr(10) || 'Yukarıdaki bağlamı kullanarak soruyu cevapla ve kaynakları belirt.') AS user_md5
      FROM benchmark LEFT JOIN c ON qid = item_id""",
    "answer_sources": f"WITH {TOP4} SELECT qid AS item_id, string_agg(source, ',' ORDER BY rank) AS sources FROM p GROUP BY qid",
    "bigram_ratio": f"SELECT doc_id, round({bigrams('text')}, 6) AS ratio FROM documents",
    "repeated_sentence": f"WITH {repeats('documents', 'doc_id', 'text')} SELECT doc_id, coalesce(sentence, '') AS sentence FROM documents LEFT JOIN rp ON id = doc_id",
    "is_degenerate": f"WITH {repeats('documents', 'doc_id', 'text')} SELECT doc_id, {bigrams('text')} < 0.75 OR sentence IS NOT NULL AS degenerate FROM documents LEFT JOIN rp ON id = doc_id",
    "support_scores": f"WITH {DIALOGUE} SELECT qid, pos, rank, round(score, 6) AS score FROM sup",
    "support_best": f"WITH {DIALOGUE} SELECT qid, pos, round(score, 6) AS score, supported, best_source FROM ver",
    "groundedness_report": f"WITH {REPORT} SELECT qid, round(score, 6) AS score, n_sentences, n_unsupported, degenerate, n_unsupported = 0 AND NOT degenerate AS is_clean, NOT degenerate AS trustworthy FROM rep",
    "answer_mode": f"""WITH {REPORT} SELECT rep.qid, CASE WHEN coalesce(hn.n, 0) = 0 THEN 'no-context' WHEN score < 0.34 OR degenerate THEN 'extractive-fallback' ELSE 'generative' END AS mode FROM rep LEFT JOIN hn USING (qid)""",
    "refusal_flag": "SELECT conv_id, turn, turn % 3 = 0 OR regexp_matches(lower(text), 'bu bilgi elimdeki belgelerde yok\\.|belgelerde yok|bilmiyorum|bilgi bulunmuyor|yeterli bilgi yok') AS refused FROM conversations",
    "keyword_hits": "SELECT doc_id, array_to_string(f, ',') AS found, len(f) AS n FROM (SELECT doc_id, list_filter(['The', 'UND', 'que', 'zzz'], lambda k: contains(lower(text), lower(k))) AS f FROM documents)",
    "recall_mrr": f"WITH {JUDGED} SELECT questions, n_answerable, round(recall_at_k, 3) AS recall_at_k, round(mrr, 3) AS mrr, round(refusal_accuracy, 3) AS refusal_accuracy, round(overall_accuracy, 3) AS overall_accuracy FROM m",
    "quality_gate": f"""WITH {JUDGED}, k AS (SELECT 'recall_at_k' AS name, round(recall_at_k, 3) AS actual, 0.84::DOUBLE AS minimum FROM m UNION ALL SELECT 'refusal_accuracy', round(refusal_accuracy, 3), 0.95::DOUBLE FROM m
      UNION ALL SELECT 'overall_accuracy', round(overall_accuracy, 3), 0.87::DOUBLE FROM m) SELECT *, actual >= minimum AS passed FROM k""",
    "calibration_grid": f"WITH {GRID} SELECT lexical_scale, min_similarity, round(recall, 6) AS recall, round(refusal, 6) AS refusal, round(overall, 6) AS overall, round(balanced, 6) AS balanced FROM gbal",
    "calibration_best": f"WITH {GRID} SELECT lexical_scale, min_similarity, round(balanced, 6) AS balanced FROM gbal ORDER BY round(balanced, 9) DESC, lexical_scale, min_similarity LIMIT 1",
    "dedup_insert": f"""SELECT doc_id, source, content_hash FROM (SELECT doc_id, source, {HASH} AS content_hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1
      AND content_hash NOT IN (SELECT {HASH} FROM documents WHERE doc_id % 7 = 0)""",
    "meta_upsert": "SELECT source AS key, CAST(coalesce(max(doc_id) FILTER (WHERE lang = 'fr'), min(doc_id)) AS VARCHAR) AS value FROM documents GROUP BY source",
    "meta_lookup": "SELECT key, coalesce((SELECT CAST(max(doc_id) AS VARCHAR) FROM documents WHERE source = key), 'none') AS value FROM (VALUES ('src3'), ('missing')) k(key)",
    "index_info": "SELECT count(*) AS chunks, count(DISTINCT source) AS sources FROM documents",
    "index_sources": "SELECT DISTINCT source FROM documents",
    "signature_check": "SELECT * FROM (VALUES ('empty', 'EmptyIndex'), ('right', 'ok'), ('foreign', 'IndexMismatch'), ('unsigned', 'ok')) v(name, outcome)",
    "job1_index_documents": f"""WITH u AS (SELECT doc_id, text, {DISTINCT_TEXT} AS content_hash FROM documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {DISTINCT_TEXT} ORDER BY doc_id) = 1),
      {expanded("d", "u", "doc_id", "text")},
      tf AS (SELECT id, term, count(*) AS tf FROM dx GROUP BY ALL),
      dlen AS (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY id),
      idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM u) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term)
      SELECT tf.id AS doc_id, content_hash, term, tf, dl, df, round(idf, 6) AS idf FROM tf JOIN idf USING (term) JOIN dlen ON dlen.id = tf.id JOIN u ON u.doc_id = tf.id""",
    "job2_audit_answers": f"""WITH {reported(RECORDED)} SELECT conv_id, turn, round(score, 6) AS score, n_sentences, n_unsupported,
      CASE WHEN degenerate THEN 'degenerate' WHEN n_unsupported > 0 THEN 'unsupported' ELSE 'clean' END AS verdict FROM rep JOIN a USING (qid)""",
}
ORACLES["bm25_topk_pruned"] = ORACLES["bm25_topk"]
ORACLES["dense_topk_pruned"] = ORACLES["dense_topk"]
ORACLES["insert_batches"] = f"""WITH c AS (SELECT doc_id, source, {HASH} AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 2 END AS b FROM documents WHERE text IS NOT NULL),
  k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY b, doc_id, source) = 1)
  SELECT row_number() OVER (ORDER BY b, source NULLS FIRST, doc_id, content_hash) AS id, doc_id, source, content_hash FROM k"""
ORACLES["chunk_document"] = f"""WITH RECURSIVE {SECTIONED}, {packed("sb", 900, 150)}
  SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY sec, n) - 1 AS INTEGER) AS chunk_index, heading, content FROM ch JOIN sb USING (id, sec)"""
ORACLES["chunk_text"] = f"""WITH RECURSIVE tx AS (SELECT doc_id AS id, 0 AS sec, text AS body FROM documents), {packed("tx", 240, 60)}
  SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS pos, content FROM ch"""
ORACLES["ingest_report"] = f"""WITH RECURSIVE {SECTIONED}, {packed("sb", 900, 150)}, c AS (SELECT id, heading, content FROM ch JOIN sb USING (id, sec))
  SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, count(DISTINCT id) AS with_chunks, count(DISTINCT (id, heading, content)) AS inserted FROM c"""
ORACLES["calibration_exact"] = f"""WITH {grid(CONFIDENCES)} SELECT lexical_scale, round(min_similarity, 6) AS min_similarity, round(recall, 6) AS recall, round(refusal, 6) AS refusal, round(overall, 6) AS overall, round(balanced, 6) AS balanced
  FROM gbal QUALIFY row_number() OVER (PARTITION BY lexical_scale ORDER BY round(balanced, 9) DESC, min_similarity) = 1"""
ORACLES["model_embed"] = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT *, length(t) % 11 = 0 AS bad FROM d)
  SELECT doc_id, CASE WHEN bad THEN -1 ELSE length(t) - length(replace(t, 'e', '')) END AS e, CASE WHEN bad THEN -1 ELSE length(t) - length(replace(t, ' ', '')) END AS spaces,
    CASE WHEN bad THEN -1 ELSE length(t) END AS chars, CASE WHEN bad THEN 'no finite vector after a second try' ELSE '' END AS error FROM f"""
ORACLES["deaccent"] = "SELECT doc_id, strip_accents(replace(text, 'ı', 'i')) AS plain FROM documents"
ORACLES["index_estimates"] = f"""WITH u AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {DISTINCT_TEXT} ORDER BY doc_id % 3, doc_id) = 1),
  {expanded("d", "u", "doc_id", "text")}
  SELECT (SELECT count(*) FROM u) AS passages, count(*) AS tokens, count(DISTINCT term) AS vocabulary, (SELECT count(DISTINCT source) FROM documents) AS origins, true AS terms_close, true AS sources_close FROM dx"""
