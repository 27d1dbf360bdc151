"""SQL counterparts of the registered queries, over the same whole tables.

Written apart from the Spark code: joins, windows and recursive queries in place of array
expressions, folds and distributed numbering.
"""

from __future__ import annotations

from arbolex.functions.labels import DEPREL, UPOS
from arbolex.functions.transitions import EAGER, EAGER_R1, HYBRID, HYBRID_R1, SYSTEMS

ORACLES: dict[str, str] = {}

_TAGS = "[" + ", ".join(f"'{t}'" for t in UPOS) + "]"
_LABELS = "[" + ", ".join(f"'{t}'" for t in DEPREL) + "]"

# Named parts, each with the parts it builds on.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "lines": (
        r"""SELECT doc_id, lang, source, line_no, doc_id * 2147483648 + line_no AS sent_id, line FROM (
            SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)""",
        (),
    ),
    "sents": (
        r"""SELECT *, len(words) AS n FROM (SELECT *, list_filter(
            regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM lines)""",
        ("lines",),
    ),
    "toks": (
        """SELECT sent_id, doc_id, lang, source, n, unnest(words) AS word, unnest(range(1, n + 1)) AS tok_id
           FROM sents""",
        ("sents",),
    ),
    "counts": ("SELECT word, count(*) AS n FROM toks GROUP BY word", ("toks",)),
    "ranked": ("SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM counts", ("counts",)),
    "reserved": ("SELECT * FROM (VALUES ('<s>', 1), ('</s>', 2), ('<unk>', 3)) t(word, id)", ()),
    "topv": (
        """SELECT word, id FROM (SELECT word, 3 + row_number() OVER (ORDER BY n DESC, word) AS id FROM (
             SELECT substring(word, 1, 65) AS word, sum(n) AS n FROM counts GROUP BY ALL)
           WHERE word NOT IN (SELECT word FROM reserved)) WHERE id <= 1003
           UNION ALL SELECT word, id FROM reserved""",
        ("counts", "reserved"),
    ),
    "allv": (
        """SELECT word, 3 + row_number() OVER (ORDER BY neg_n, first_word) AS id FROM (
             SELECT cut AS word, min({'a': -n, 'b': word}).a AS neg_n, min({'a': -n, 'b': word}).b AS first_word
             FROM (SELECT substring(word, 1, 65) AS cut, word, n FROM counts)
             WHERE cut NOT IN (SELECT word FROM reserved) GROUP BY cut)
           UNION ALL SELECT word, id FROM reserved""",
        ("counts", "reserved"),
    ),
    "chars": (
        """SELECT ch, 3 + row_number() OVER (ORDER BY rank, pos) AS id FROM (
             SELECT ch, min({'rank': rank, 'pos': pos}).rank AS rank, min({'rank': rank, 'pos': pos}).pos AS pos
             FROM (SELECT rank, unnest(string_split(word, '')) AS ch, unnest(range(1, length(word) + 1)) AS pos
                   FROM ranked)
             WHERE ch NOT IN (' ', chr(17), chr(18), chr(19)) GROUP BY ch)
           UNION ALL SELECT chr(17), 1 UNION ALL SELECT chr(18), 2 UNION ALL SELECT chr(19), 3""",
        ("ranked",),
    ),
    "head_chars": (
        """SELECT ch, 3 + row_number() OVER (ORDER BY rank, pos) AS id FROM (
             SELECT ch, min({'rank': rank, 'pos': pos}).rank AS rank, min({'rank': rank, 'pos': pos}).pos AS pos
             FROM (SELECT rank, unnest(string_split(word, '')) AS ch, unnest(range(1, length(word) + 1)) AS pos
                   FROM ranked WHERE rank <= 40000)
             WHERE ch NOT IN (' ', chr(17), chr(18), chr(19)) GROUP BY ch)
           UNION ALL SELECT chr(17), 1 UNION ALL SELECT chr(18), 2 UNION ALL SELECT chr(19), 3""",
        ("ranked",),
    ),
    "dual": (
        """SELECT t.sent_id, t.n, t.tok_id, coalesce(o.id, 3) AS out_id, coalesce(i.id, 3) AS in_id
           FROM toks t LEFT JOIN topv o ON t.word = o.word LEFT JOIN allv i ON t.word = i.word
           UNION ALL SELECT sent_id, n, 0, 1, 1 FROM sents
           UNION ALL SELECT sent_id, n, n + 1, 2, 2 FROM sents""",
        ("toks", "sents", "topv", "allv"),
    ),
    # treebank view
    "chunks": (
        """SELECT doc_id, lang, source, line_no, words, unnest(range(0, (n + 25) // 26)) AS c FROM sents""",
        ("sents",),
    ),
    "tb": (
        """SELECT doc_id * 2147483648 + row_number() OVER (PARTITION BY doc_id ORDER BY line_no, c) AS sent_id,
                  doc_id, lang, source, words[c * 26 + 1 : c * 26 + 26] AS forms,
                  len(words[c * 26 + 1 : c * 26 + 26]) AS n FROM chunks""",
        ("chunks",),
    ),
    "tt": (
        """SELECT *, (7 * length(form) + tok_id) % 17 + 1 AS upos,
             CASE WHEN tok_id = r THEN 0
                  WHEN tok_id < r THEN CASE WHEN (r - tok_id) % 3 = 1 THEN r ELSE tok_id + 1 END
                  WHEN (tok_id - r) % 3 = 1 THEN r ELSE tok_id - 1 END AS head,
             CASE WHEN tok_id = r THEN 1 ELSE 2 + (5 * tok_id + length(form)) % 36 END AS deprel,
             CASE WHEN tok_id = r THEN 0 WHEN (sent_id + tok_id) % 5 = 0 THEN r
                  WHEN tok_id < r THEN tok_id + 1 ELSE tok_id - 1 END AS pred_head
           FROM (SELECT sent_id, lang, n, (n + 1) // 2 AS r, unnest(forms) AS form,
                        unnest(range(1, n + 1)) AS tok_id FROM tb)""",
        ("tb",),
    ),
    "nested": (
        """SELECT sent_id, any_value(lang) AS lang, any_value(n) AS n,
             list(upos ORDER BY tok_id) AS upos, list(head ORDER BY tok_id) AS heads,
             list(deprel ORDER BY tok_id) AS deprels FROM tt GROUP BY sent_id""",
        ("tt",),
    ),
    "tangled_tt": (
        """SELECT *, CASE WHEN thead = 0 THEN 1 ELSE greatest(deprel, 2) END AS tdeprel FROM (
             SELECT *, length(form) % tok_id AS thead FROM tt)""",
        ("tt",),
    ),
    "tangled": (
        """SELECT sent_id, any_value(n) AS n, list(upos ORDER BY tok_id) AS upos,
             list(thead ORDER BY tok_id) AS heads, list(tdeprel ORDER BY tok_id) AS deprels
           FROM tangled_tt GROUP BY sent_id""",
        ("tangled_tt",),
    ),
    "rendered": (
        f"""SELECT sent_id, tok_id, n, form, head, pred_head, deprel, length(form) AS len,
              {_TAGS}[upos] AS tag, {_LABELS}[deprel] AS label FROM tt""",
        ("tt",),
    ),
    "tb_vocab": (
        """SELECT word, 2 + row_number() OVER (ORDER BY s, t) AS id, n FROM (
             SELECT form AS word, min({'s': sent_id, 't': tok_id}).s AS s, min({'s': sent_id, 't': tok_id}).t AS t,
                    count(*) AS n FROM tt WHERE form NOT IN ('<s>', '</s>') GROUP BY form)
           UNION ALL SELECT word, id, (SELECT count(*) FROM tt WHERE form = word) FROM reserved WHERE id < 3""",
        ("tt", "reserved"),
    ),
    "corpus_batch": (
        """SELECT *, max(n) OVER (PARTITION BY batch_no) AS max_n FROM (
             SELECT sent_id, n, (row_number() OVER (ORDER BY sent_id) - 1) // 128 AS batch_no FROM tb)""",
        ("tb",),
    ),
    "spelled": (
        """SELECT id, word, (id - 4) // 25 AS batch_no, (id - 4) % 25 AS slot, length(word) AS len,
                  max(length(word)) OVER (PARTITION BY (id - 4) // 25) AS max_n, char_ids FROM (
             SELECT v.id, v.word, list(coalesce(c.id, 1) ORDER BY v.pos) AS char_ids FROM (
               SELECT id, word, unnest(string_split(word, '')) AS ch, unnest(range(1, length(word) + 1)) AS pos
               FROM allv WHERE id > 3) v LEFT JOIN chars c ON v.ch = c.ch GROUP BY v.id, v.word)""",
        ("allv", "chars"),
    ),
    # language model
    "ctx": (
        """SELECT sent_id, tok_id, n, fold, lang, source, w,
             lag(w, 1, 1) OVER (PARTITION BY sent_id ORDER BY tok_id) AS l,
             lead(w, 1, 2) OVER (PARTITION BY sent_id ORDER BY tok_id) AS r FROM (
           SELECT t.*, t.doc_id % 2 AS fold, coalesce(v.id, 3) AS w FROM toks t LEFT JOIN topv v ON t.word = v.word)""",
        ("toks", "topv"),
    ),
    "tri": ("SELECT 1 - fold AS fold, l, w, r, count(*) AS n FROM ctx GROUP BY ALL", ("ctx",)),
    "logprob": (
        """SELECT c.*, ln(0.5 * coalesce(lwr.n / lr.n, 0) + 0.15 * coalesce(lw.n / l.n, 0)
               + 0.15 * coalesce(wr.n / r.n, 0)
               + 0.2 * (coalesce(w.n, 0) + 0.1) / (a.n + (SELECT count(*) FROM topv) * 0.1)) AS logp
           FROM ctx c
           LEFT JOIN tri lwr ON c.fold = lwr.fold AND c.l = lwr.l AND c.w = lwr.w AND c.r = lwr.r
           LEFT JOIN (SELECT fold, l, r, sum(n) AS n FROM tri GROUP BY ALL) lr
                  ON c.fold = lr.fold AND c.l = lr.l AND c.r = lr.r
           LEFT JOIN (SELECT fold, l, w, sum(n) AS n FROM tri GROUP BY ALL) lw
                  ON c.fold = lw.fold AND c.l = lw.l AND c.w = lw.w
           LEFT JOIN (SELECT fold, w, r, sum(n) AS n FROM tri GROUP BY ALL) wr
                  ON c.fold = wr.fold AND c.w = wr.w AND c.r = wr.r
           LEFT JOIN (SELECT fold, l, sum(n) AS n FROM tri GROUP BY ALL) l ON c.fold = l.fold AND c.l = l.l
           LEFT JOIN (SELECT fold, r, sum(n) AS n FROM tri GROUP BY ALL) r ON c.fold = r.fold AND c.r = r.r
           LEFT JOIN (SELECT fold, w, sum(n) AS n FROM tri GROUP BY ALL) w ON c.fold = w.fold AND c.w = w.w
           LEFT JOIN (SELECT fold, sum(n) AS n FROM tri GROUP BY ALL) a ON c.fold = a.fold""",
        ("ctx", "tri", "topv"),
    ),
    # events as candidates and series
    "cand": (
        """SELECT user_id AS sent_id, CAST(event_id % 4 AS INT) AS parent, event_id AS move, value / 10 AS score,
             (user_id + event_id) % 2 AS parent_cost, event_id % 3 AS move_cost, user_id % 2 = 0 AS is_final FROM events""",
        (),
    ),
    "cand_top": (
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, parent, move) AS slot
           FROM cand) WHERE slot <= 4""",
        ("cand",),
    ),
    "cand_gold": (
        """SELECT sent_id, g.parent AS parent, g.move AS move, g.score AS score FROM (
             SELECT sent_id, min(parent) FILTER (parent_cost = 0) AS p0,
               min({'parent': parent, 'move': move, 'score': score})
                 FILTER (parent_cost = 0 AND move_cost = 0) AS g FROM cand GROUP BY sent_id)
           WHERE g.parent = p0""",
        ("cand",),
    ),
    "curve": (
        """SELECT date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS epoch, avg(value) AS score
           FROM events GROUP BY ts::DATE""",
        (),
    ),
    "vec": (
        """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last,
             list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings""",
        (),
    ),
    "label_vec": (
        """SELECT vec_id % 37 + 1 AS deprel, avg(first) AS first, avg(last) AS last, avg(total) AS total
           FROM vec GROUP BY 1""",
        ("vec",),
    ),
}


def sql(name: str, body: str, *parts: str, extra: str = "") -> None:
    """Register ``body`` behind the parts it needs, each part once and in order."""
    ordered: list[str] = []

    def add(part: str) -> None:
        for needed in PARTS[part][1]:
            add(needed)
        if part not in ordered:
            ordered.append(part)

    for part in parts:
        add(part)
    named = [f"{p} AS ({PARTS[p][0]})" for p in ordered] + ([extra] if extra else [])
    ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(named) + "\n" if named else "") + body


# ---- scans, sources, sinks

sql("line_scan", "SELECT sent_id, line_no, line FROM lines", "lines")
sql(
    "conllu_scan",
    """SELECT dense_rank() OVER (ORDER BY sent_id) AS sent_id, tok_id, form, upos, head, deprel FROM tt""",
    "tt",
)
sql(
    "corpus_union",
    r"""SELECT corpus, count(*) AS n_sent, CAST(sum(len(list_filter(
          regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS BIGINT) AS n_words
        FROM (SELECT 'documents' AS corpus, unnest(string_split(text, chr(10))) AS line FROM documents
              UNION ALL SELECT 'conversations', unnest(string_split(text, chr(10))) FROM conversations
              UNION ALL SELECT 'documents_again', unnest(string_split(text, chr(10))) FROM documents)
        GROUP BY corpus""",
)
sql("count_file_scan", "SELECT word, n FROM counts", "counts")
sql("count_file_sink", "SELECT n || ' ' || word AS line FROM counts", "counts")
sql("vocab_ids", "SELECT word, id FROM allv", "allv")
_EXTRA_LINE = r"chr(9) || '_' || chr(9) || '_' || chr(9) || 'X' || repeat(chr(9) || '_', 6)"
sql(
    "conllu_rewrite",
    f"""SELECT sent_id, 1 AS line_no, '# sent_id = ' || sent_id AS raw FROM tb
        UNION ALL SELECT sent_id, 2, '1-2' || {_EXTRA_LINE} FROM tb WHERE n > 1
        UNION ALL SELECT sent_id, tok_id + CASE WHEN n > 1 THEN 2 ELSE 1 END,
          concat_ws(chr(9), tok_id, form, '_', tag, '_', '_', pred_head, label, '_', '_') FROM rendered
        UNION ALL SELECT sent_id, n + 3, '2.1' || {_EXTRA_LINE} FROM tb WHERE n > 1""",
    "rendered",
    "tb",
)
sql(
    "vocab_roundtrip",
    """SELECT 'word_vocab' AS part, count(*) AS n FROM topv UNION ALL SELECT 'char_vocab', count(*) FROM chars
       UNION ALL SELECT 'tags', 17 UNION ALL SELECT 'labels', 37""",
    "topv",
    "chars",
)

sql(
    "vocab_contents",
    f"""SELECT 'word_vocab' AS part, id, word AS item FROM topv UNION ALL SELECT 'char_vocab', id, ch FROM chars
       UNION ALL SELECT 'tags', i, {_TAGS}[i] FROM range(1, 18) r(i) UNION ALL SELECT 'labels', i, {_LABELS}[i] FROM range(1, 38) r(i)""",
    "topv",
    "chars",
)

# ---- projections and filters

sql("tokenize", "SELECT sent_id, tok_id, word FROM toks", "toks")
sql("words_file", "SELECT word FROM counts", "counts")
sql("length_filter", "SELECT sent_id, n FROM sents WHERE n <= 26", "sents")
sql("train_length_filter", "SELECT sent_id, n FROM sents WHERE n BETWEEN 2 AND 64", "sents")
sql(
    "vocab_quality",
    """SELECT count(*) AS n_lines, count(*) FILTER (n = 0) AS n_blank, count(*) FILTER (n > 1) AS n_multi,
         count(*) FILTER (length(words[1]) > 65) AS n_long, count(*) FILTER (n > 0) AS n_kept FROM sents""",
    "sents",
)
sql(
    "truncate_words",
    "SELECT word, substring(word, 1, 65) AS vocab_word, substring(word, 1, 32) AS char_word FROM counts",
    "counts",
)
sql(
    "reserved_chars",
    """SELECT count(*) AS n_words, CAST(count(*) FILTER (hit) AS BIGINT) AS n_reserved_words,
         CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS n_reserved_tokens
       FROM (SELECT *, contains(word, chr(17)) OR contains(word, chr(18)) OR contains(word, chr(19)) AS hit FROM counts)""",
    "counts",
)
sql(
    "treebank_quality",
    """SELECT count(DISTINCT sent_id) AS n_sent, count(*) AS n_tok, count(*) FILTER (t) AS bad_tag,
         count(*) FILTER (h) AS bad_head, count(*) FILTER (l) AS bad_label, count(*) FILTER (m) AS bad_root,
         count(DISTINCT sent_id) FILTER (t OR h OR l OR m) AS n_set_aside
       FROM (SELECT sent_id, len % 11 = 0 AS t, len % 13 = 0 AS h, len % 17 = 0 AS l,
               len % 17 <> 0 AND len % 13 <> 0 AND head > 0 AND (len % 19 = 0 OR label = 'root') AS m FROM rendered)""",
    "rendered",
)
sql("char_vocab", "SELECT ch, id FROM head_chars", "head_chars")

# ---- joins

sql(
    "encode_tokens",
    """SELECT sent_id, count(*) AS n, count(*) FILTER (id IS NULL) AS n_unk,
         string_agg(CAST(coalesce(id, 3) AS VARCHAR), ' ' ORDER BY tok_id) AS ids
       FROM toks LEFT JOIN topv USING (word) GROUP BY sent_id""",
    "toks",
    "topv",
)
sql(
    "encode_dual",
    """SELECT sent_id, count(*) AS seq_len, string_agg(CAST(out_id AS VARCHAR), ' ' ORDER BY tok_id) AS out_ids,
         string_agg(CAST(in_id AS VARCHAR), ' ' ORDER BY tok_id) AS in_ids FROM dual GROUP BY sent_id""",
    "dual",
)
sql(
    "decode_ids",
    """SELECT sent_id, '<s> ' || string_agg(CASE WHEN word IN (SELECT word FROM topv) THEN word ELSE '<unk>' END,
         ' ' ORDER BY tok_id) || ' </s>' AS out_text,
         '<s> ' || string_agg(substring(word, 1, 65), ' ' ORDER BY tok_id) || ' </s>' AS in_text
       FROM toks GROUP BY sent_id""",
    "toks",
    "topv",
)
sql(
    "unk_rate",
    """SELECT CAST(count(*) FILTER (id IS NULL) AS BIGINT) AS unknown, count(*) AS total,
         round(count(*) FILTER (id IS NULL) / count(*), 9) AS unk_rate FROM toks LEFT JOIN topv USING (word)""",
    "toks",
    "topv",
)
sql("oov_words", "SELECT word, n FROM counts WHERE word NOT IN (SELECT word FROM topv)", "counts", "topv")
sql(
    "gather_vectors",
    """SELECT sent_id, tok_id, round(first, 6) AS v_first, round(last, 6) AS v_last, round(total, 6) AS v_sum
       FROM tt JOIN tb_vocab v ON tt.form = v.word JOIN vec ON vec_id = v.id % (SELECT count(*) FROM embeddings)""",
    "tt",
    "tb_vocab",
    "vec",
)
sql(
    "head_of_head",
    """SELECT a.sent_id, a.tok_id, b.tok_id AS head1, nullif(b.head, 0) AS head2
       FROM tt a LEFT JOIN tt b ON a.sent_id = b.sent_id AND a.head = b.tok_id""",
    "tt",
)
sql(
    "align_right",
    """SELECT sent_id, batch_no, tok_id, max_n - n + tok_id AS step FROM (
         SELECT *, unnest(range(1, n + 1)) AS tok_id FROM corpus_batch)""",
    "corpus_batch",
)

# ---- aggregations

sql("word_count", "SELECT word, n FROM counts", "counts")
sql("word_count_sorted", "SELECT word, n FROM counts ORDER BY n DESC, word", "counts")
sql(
    "vocab_coverage",
    """SELECT s AS vocab_size, CAST(sum(n) FILTER (rank <= s) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS total,
         round(sum(n) FILTER (rank <= s) / sum(n) * 100, 6) AS coverage
       FROM ranked, (VALUES (100), (1000), (10000)) t(s) GROUP BY s""",
    "ranked",
)
sql(
    "max_lengths",
    """SELECT max(length(word)) AS max_word_chars, least(max(length(word)), 32) AS max_encoded_chars,
         max(n) AS max_sentence_words FROM toks""",
    "toks",
)
sql(
    "corpus_stats",
    """SELECT count(*) AS n_sent_all, CAST(sum(n) AS BIGINT) AS n_word_all,
         CAST(count(*) FILTER (n BETWEEN 2 AND 64) AS BIGINT) AS n_sent,
         CAST(sum(n) FILTER (n BETWEEN 2 AND 64) AS BIGINT) AS n_word FROM sents""",
    "sents",
)
sql(
    "first_seen_ids",
    """SELECT v.id, v.word, string_agg(CAST(coalesce(c.id, 1) AS VARCHAR), ' ' ORDER BY pos) AS char_ids FROM (
         SELECT id, word, unnest(string_split(substring(word, 1, 32), '')) AS ch,
                unnest(range(1, length(substring(word, 1, 32)) + 1)) AS pos FROM tb_vocab) v
       LEFT JOIN chars c ON v.ch = c.ch GROUP BY v.id, v.word""",
    "tb_vocab",
    "chars",
)
sql(
    "dependents",
    """SELECT sent_id, head,
         coalesce(string_agg(CAST(tok_id AS VARCHAR), ' ' ORDER BY tok_id) FILTER (tok_id < head), '') AS ldeps,
         coalesce(string_agg(CAST(tok_id AS VARCHAR), ' ' ORDER BY tok_id DESC) FILTER (tok_id > head), '') AS rdeps
       FROM tt WHERE head > 0 GROUP BY sent_id, head""",
    "tt",
)
sql(
    "valency_buckets",
    """SELECT a.sent_id, a.tok_id, least(count(b.tok_id) FILTER (b.tok_id < a.tok_id) + 1, 10) AS left_bucket,
         least(count(b.tok_id) FILTER (b.tok_id > a.tok_id) + 1, 10) AS right_bucket
       FROM tt a LEFT JOIN tt b ON a.sent_id = b.sent_id AND b.head = a.tok_id GROUP BY a.sent_id, a.tok_id""",
    "tt",
)
sql(
    "vector_sum_by_head",
    "SELECT sent_id, head, "
    + ", ".join(
        f"round(coalesce(sum({v}) FILTER (tok_id {op} head), 0), 6) AS {side}_{name}"
        for side, op in (("left", "<"), ("right", ">"))
        for v, name in (("first", "first"), ("last", "last"), ("total", "sum"))
    )
    + " FROM tt JOIN label_vec USING (deprel) WHERE head > 0 GROUP BY sent_id, head",
    "tt",
    "label_vec",
)
sql("move_total", "SELECT count(*) AS n_sent, CAST(sum(2 * (n - 1)) AS BIGINT) AS n_moves FROM tb", "tb")
sql(
    "logsumexp_by_group",
    """SELECT sent_id, parent, round(any_value(m) + ln(sum(exp(score - m))), 6) AS logsumexp FROM (
         SELECT *, max(score) OVER (PARTITION BY sent_id, parent) AS m FROM cand) GROUP BY sent_id, parent""",
    "cand",
)
sql(
    "las",
    """SELECT lang, count(*) AS n_words, count(*) FILTER (head = pred_head) AS n_correct,
         round(count(*) FILTER (head = pred_head) / count(*), 9) AS las FROM tt GROUP BY lang""",
    "tt",
)
sql(
    "tree_cost",
    "SELECT sent_id, any_value(n) AS n, count(*) FILTER (head <> pred_head) AS cost FROM tt GROUP BY sent_id",
    "tt",
)

# ---- window functions, sorts, top-k

sql("top_n_vocab", "SELECT word, n, rank FROM ranked WHERE rank <= 1000", "ranked")
sql(
    "coverage_curve",
    """SELECT rank, word, n, CAST(sum(n) OVER (ORDER BY rank) AS BIGINT) AS covered,
         round(sum(n) OVER (ORDER BY rank) / sum(n) OVER () * 100, 6) AS coverage FROM ranked""",
    "ranked",
)
sql(
    "context_windows",
    """SELECT sent_id, tok_id, word,
         coalesce(lag(word) OVER w, '<s>') AS left_word, coalesce(lead(word) OVER w, '</s>') AS right_word,
         tok_id - 1 AS n_left, n - tok_id AS n_right,
         CAST(coalesce(sum(length(word)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_chars,
         CAST(coalesce(sum(length(word)) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS right_chars
       FROM toks WINDOW w AS (PARTITION BY sent_id ORDER BY tok_id)""",
    "toks",
)
_BUCKETS = """bucketed AS (SELECT sent_id, n + 2 AS seq_len, count(*) OVER (PARTITION BY n) AS size,
    row_number() OVER (PARTITION BY n ORDER BY sent_id) - 1 AS i FROM sents),
  batched AS (SELECT sent_id, seq_len, i // 25 AS batch_no, i % 25 AS slot FROM bucketed WHERE i < size // 25 * 25)"""
sql("length_bucket_batches", "SELECT * FROM batched", "sents", extra=_BUCKETS)
_READY = "ready AS (SELECT n + 2 AS seq_len, count(*) AS n_seq, count(*) // 25 AS n_batches FROM sents GROUP BY n HAVING count(*) >= 25)"
sql("ready_buckets", "SELECT * FROM ready", "sents", extra=_READY)
sql("pick_bucket", "SELECT seq_len FROM ready ORDER BY md5(seq_len || ':4') LIMIT 1", "sents", extra=_READY)
_MINI = """mini AS (SELECT sent_id, n, i // 16 AS batch_no, i % 16 AS slot FROM (
    SELECT sent_id, n, row_number() OVER (ORDER BY n, sent_id) - 1 AS i FROM sents))"""
sql("minibatches", "SELECT * FROM mini", "sents", extra=_MINI)
sql(
    "shuffle_batches",
    """SELECT batch_no, count(*) AS n_sent, row_number() OVER (ORDER BY md5(batch_no || ':4'), batch_no) AS position
       FROM mini GROUP BY batch_no""",
    "sents",
    extra=_MINI,
)


def _running(warm: int, decay: float) -> tuple[str, str]:
    part = f"""series AS MATERIALIZED (SELECT event_type AS series, event_id AS ord, value AS loss,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
      folded AS (SELECT series, ord, k, loss, loss AS avg_loss FROM series WHERE k = 1
        UNION ALL SELECT s.series, s.ord, s.k, s.loss,
          CASE WHEN s.k < {warm} THEN (s.loss + (s.k - 1) * f.avg_loss) / s.k
               ELSE f.avg_loss * {decay} + s.loss * (1 - {decay}::DOUBLE) END
        FROM folded f JOIN series s ON s.series = f.series AND s.k = f.k + 1)"""
    return part, "SELECT series, ord, k, loss, round(avg_loss + 1e-9, 6) AS avg_loss FROM folded"


for _name, _args in {
    "running_loss": (100, 0.99),
    "running_loss_parser": (1000, 0.999),
    "stream_running_loss": (100, 0.99),
}.items():
    _part, _body = _running(*_args)
    sql(_name, _body, extra=_part)

sql(
    "best_epoch",
    """SELECT epoch, round(score, 6) AS score, best_epoch, round(best_score, 6) AS best_score,
         stop AND seen = 1 AS stops_here, seen = 0 OR (stop AND seen = 1) AS trained
       FROM (SELECT *, sum(CAST(stop AS INT)) OVER (ORDER BY epoch) AS seen FROM (
         SELECT *, best_epoch > 5 AND best_epoch < epoch - 5 AS stop FROM (
           SELECT a.epoch, a.score, max(b.score) AS best_score, min(b.epoch) FILTER (b.score = a.top) AS best_epoch
           FROM (SELECT *, max(score) OVER (ORDER BY epoch) AS top FROM curve) a
           JOIN curve b ON b.epoch <= a.epoch GROUP BY a.epoch, a.score)))""",
    "curve",
)
sql("beam_topk", "SELECT sent_id, slot, parent, move, score FROM cand_top", "cand_top")
sql("beam_gold", "SELECT sent_id, parent, move, score FROM cand_gold", "cand_gold")
sql(
    "beam_loss",
    """SELECT sent_id, held IS NULL AS early_stop, round(CASE
           WHEN held IS NULL THEN ln(list_sum(list_transform(scores, lambda s: exp(s - gold))) + 1)
           WHEN is_final THEN ln(list_sum(list_transform(scores, lambda s: exp(s - gold)))) ELSE 0 END, 6) AS loss
       FROM (SELECT b.*, coalesce(b.held, g.score) AS gold FROM (
               SELECT sent_id, list(score) AS scores, bool_or(is_final) AS is_final,
                      arg_min(score, slot) FILTER (parent_cost + move_cost = 0) AS held FROM cand_top GROUP BY sent_id) b
             LEFT JOIN cand_gold g USING (sent_id)) WHERE gold IS NOT NULL""",
    "cand_gold",
    "cand_top",
)

# ---- padding and batch tables

sql(
    "pad_token_batch",
    """SELECT sent_id, batch_no, width, md5(array_to_string(list_concat(
           list_transform(range(0, width - n - 2), lambda x: 2), [1], ids, [2]), ' ')) AS ids_md5,
         n + 2 AS mask_sum
       FROM (SELECT b.sent_id, b.batch_no, b.n, b.max_n + 2 AS width, list(v.id ORDER BY tt.tok_id) AS ids
             FROM corpus_batch b JOIN tt USING (sent_id) JOIN tb_vocab v ON tt.form = v.word
             GROUP BY b.sent_id, b.batch_no, b.n, b.max_n)""",
    "corpus_batch",
    "tt",
    "tb_vocab",
)
sql(
    "pad_gold_batch",
    """SELECT sent_id, batch_no, width, md5(array_to_string(list_concat(
           list_transform(range(0, width - n), lambda x: 3), ids), ' ')) AS ids_md5, n AS mask_sum
       FROM (SELECT b.sent_id, b.batch_no, b.n, b.max_n AS width, list(coalesce(v.id, 3) ORDER BY tt.tok_id) AS ids
             FROM corpus_batch b JOIN tt USING (sent_id) LEFT JOIN topv v ON tt.form = v.word
             GROUP BY b.sent_id, b.batch_no, b.n, b.max_n)""",
    "corpus_batch",
    "tt",
    "topv",
)
sql(
    "pad_char_batch",
    """SELECT id, batch_no, slot, max_n + 2 AS width, repeat('1 ', CAST(max_n - len AS BIGINT)) || '2 '
         || array_to_string(char_ids, ' ') || ' 3' AS ids, len + 2 AS mask_sum FROM spelled""",
    "spelled",
)
# the words of every batch and time step, marks and unknown words spelled out like others
_STEPS = """steps AS (
      SELECT b.seq_len, b.batch_no, d.tok_id + 1 AS step, b.slot, s.chars, len(s.chars) AS len
      FROM batched b JOIN dual d USING (sent_id) JOIN (
        SELECT v.id, list(coalesce(c.id, 1) ORDER BY v.pos) AS chars FROM (
          SELECT id, unnest(string_split(word, '')) AS ch, unnest(range(1, length(word) + 1)) AS pos FROM allv) v
        LEFT JOIN chars c ON v.ch = c.ch GROUP BY v.id) s ON d.in_id = s.id)"""
sql(
    "pad_char_steps",
    """SELECT seq_len, batch_no, step, any_value(longest) + 2 AS width, CAST(sum(len + 2) AS BIGINT) AS mask_sum,
         md5(string_agg(repeat('1 ', longest - len) || '2 ' || array_to_string(chars, ' ') || ' 3', ' ' ORDER BY slot)) AS ids_md5
       FROM (SELECT *, max(len) OVER (PARTITION BY seq_len, batch_no, step) AS longest FROM steps) GROUP BY seq_len, batch_no, step""",
    "dual",
    "allv",
    "chars",
    extra=_BUCKETS + ",\n" + _STEPS,
)
sql(
    "concat_char_steps",
    """SELECT seq_len, batch_no, step, 25 * (m + 2) AS width, CAST(sum(len + 2) AS BIGINT) AS mask_sum,
         md5(string_agg('2 ' || array_to_string(chars, ' ') || ' 3' || repeat(' 1', m - len), ' ' ORDER BY slot)) AS ids_md5
       FROM steps, (SELECT max(length(word)) AS m FROM allv) GROUP BY seq_len, batch_no, step, m""",
    "dual",
    "allv",
    "chars",
    extra=_BUCKETS + ",\n" + _STEPS,
)
sql(
    "pad_vocab_right",
    """SELECT id, chr(18) || word || chr(19) || repeat(chr(17), (SELECT max(length(word)) FROM allv) - length(word)) AS key
       FROM allv""",
    "allv",
)
sql(
    "concat_char_batch",
    """SELECT batch_no, count(*) * (m + 2) AS width, CAST(sum(len + 2) AS BIGINT) AS mask_sum,
         md5(string_agg('2 ' || array_to_string(char_ids, ' ') || ' 3' || repeat(' 1', m - len), ' ' ORDER BY slot)) AS ids_md5
       FROM spelled, (SELECT max(length(word)) AS m FROM allv) GROUP BY batch_no, m""",
    "spelled",
)
sql(
    "time_major",
    """SELECT b.seq_len, b.batch_no, d.tok_id + 1 AS step,
         string_agg(CAST(d.out_id AS VARCHAR), ' ' ORDER BY b.slot) AS out_ids,
         string_agg(CAST(d.in_id AS VARCHAR), ' ' ORDER BY b.slot) AS in_ids
       FROM batched b JOIN dual d USING (sent_id) GROUP BY b.seq_len, b.batch_no, d.tok_id""",
    "dual",
    extra=_BUCKETS,
)

# ---- language model

sql(
    "context_counts",
    """SELECT concat(CASE WHEN grouping(l) = 0 THEN 'l' ELSE '_' END, CASE WHEN grouping(w) = 0 THEN 'w' ELSE '_' END,
         CASE WHEN grouping(r) = 0 THEN 'r' ELSE '_' END) AS kind,
         coalesce(l, 0) AS l, coalesce(w, 0) AS w, coalesce(r, 0) AS r, count(*) AS n
       FROM ctx GROUP BY GROUPING SETS ((l, w, r), (l, r), (l, w), (w, r), (l), (r), (w))""",
    "ctx",
)
sql("token_logprob", "SELECT sent_id, tok_id, round(logp, 6) AS logp FROM logprob", "logprob")
sql("perplexity", "SELECT count(*) AS n_tokens, round(exp(-avg(logp)), 6) AS perplexity FROM logprob", "logprob")
sql(
    "perplexity_by_lang",
    """SELECT lang, source, count(*) AS n_tokens, round(exp(-avg(logp)), 6) AS perplexity
       FROM logprob GROUP BY lang, source""",
    "logprob",
)
sql(
    "perplexity_macro",
    """SELECT count(*) AS n_batches, round(exp(-avg(m)), 6) AS perplexity FROM (
         SELECT b.seq_len, b.batch_no, avg(logp) AS m FROM batched b JOIN logprob USING (sent_id) GROUP BY ALL)""",
    "logprob",
    extra=_BUCKETS,
)


sql(
    "batch_losses",
    """SELECT k AS ord, seq_len, batch_no, round(loss, 5) AS loss, round(avg_loss, 5) AS avg_loss FROM averaged""",
    "logprob",
    extra=_BUCKETS
    + """,
    means AS MATERIALIZED (
      SELECT seq_len, batch_no, -avg(logp) AS loss, row_number() OVER (ORDER BY md5(concat(seq_len, ':', batch_no, ':4'))) AS k
      FROM batched JOIN logprob USING (sent_id) GROUP BY seq_len, batch_no),
    averaged AS (
      SELECT k, seq_len, batch_no, loss, loss AS avg_loss FROM means WHERE k = 1
      UNION ALL
      SELECT m.k, m.seq_len, m.batch_no, m.loss,
             CASE WHEN m.k < 100 THEN (a.avg_loss * (m.k - 1) + m.loss) / m.k ELSE 0.99::DOUBLE * a.avg_loss + (1 - 0.99::DOUBLE) * m.loss END
      FROM averaged a JOIN means m ON m.k = a.k + 1)""",
)


def _side(side: str, frame: str) -> str:
    return ", ".join(
        f"round(coalesce(avg({v}) OVER (w ROWS BETWEEN {frame}), 0), 6) AS {side}_{name}"
        for v, name in (("first", "first"), ("last", "last"), ("total", "sum"))
    )


sql(
    "context_vectors",
    f"""SELECT sent_id, tok_id, {_side("left", "2 PRECEDING AND 1 PRECEDING")},
          {_side("right", "1 FOLLOWING AND 2 FOLLOWING")}
        FROM (SELECT tt.sent_id, tt.tok_id, vec.* FROM tt LEFT JOIN topv v ON tt.form = v.word
              JOIN vec ON vec_id = coalesce(v.id, 3) % (SELECT count(*) FROM embeddings))
        WINDOW w AS (PARTITION BY sent_id ORDER BY tok_id)""",
    "tt",
    "topv",
    "vec",
)

# ---- transitions: one row per sentence and step, state after the step


def _contains(items: str, x: str) -> str:
    return f"CAST(list_contains({items}, {x}) AS INT)"


def _system_sql(system: str, name: str, source: str) -> str:
    """Recursive part ``name``: the cheapest move at each step and the state it leads to.

    ``c_*`` are the costs before the move (32767 when illegal), ``g_*`` the gold label of the arc or
    0, ``p_*`` the words in focus before the move.
    """
    hybrid, one_root = system in (HYBRID, HYBRID_R1), system in (EAGER_R1, HYBRID_R1)
    n_move = 73 if system == HYBRID_R1 else 74
    if system == EAGER:
        legal = {
            "s": "n0 <= n",
            "d": "sz > 0 AND (h0 <> 0 OR (n0 > n AND sz > 1))",
            "l": "n0 <= n AND sz > 0 AND h0 = 0",
            "r": "n0 <= n AND sz > 0",
        }
    elif system == EAGER_R1:
        legal = {
            "s": "n0 < n OR (n0 = n AND sz = 0)",
            "d": "sz > 0 AND h0 <> 0",
            "l": "sz > 0 AND n0 <= n AND h0 = 0",
            "r": "sz > 0 AND (n0 < n OR (n0 = n AND len(list_filter(stack, lambda x: head[x] = 0)) = 1))",
        }
    else:
        legal = {
            "s": "n0 <= n",
            "d": "false" if one_root else "sz = 1 AND n0 <= n",
            "l": "n0 <= n AND sz > 0",
            "r": "sz > 1",
        }
    if hybrid:
        cost = {
            "s": "n0l + CASE WHEN gn <> s0 AND list_contains(stack, gn) THEN 1 ELSE 0 END"
            " + CASE WHEN gn = 0 AND sz > 0 THEN 1 ELSE 0 END",
            "d": "s0r + CASE WHEN gs >= n0 THEN 1 ELSE 0 END",
            "l": "s0r + CASE WHEN gs > n0 OR (sz = 1 AND gs = 0) OR (sz > 1 AND gs = s1) THEN 1 ELSE 0 END",
            "r": "s0r + CASE WHEN gs >= n0 THEN 1 ELSE 0 END",
        }
        right_head, right_dep = "s1", "s0"
    else:
        cost = {
            "s": f"n0l + {_contains('stack', 'gn')}",
            "d": "s0r",
            "l": "s0r + CASE WHEN gs > n0 THEN 1 ELSE 0 END + CASE WHEN gs = 0 THEN 1 ELSE 0 END",
            "r": "n0l + CASE WHEN gn > n0 THEN 1 ELSE 0 END + CASE WHEN gn = 0 THEN 1 ELSE 0 END"
            " + CASE WHEN gn <> s0 AND list_contains(stack, gn) THEN 1 ELSE 0 END",
        }
        right_head, right_dep = "s0", "n0"
    pushes = "move = 1" if hybrid else f"(move = 1 OR (move % 2 = 1 AND move > 1 AND move < {n_move}))"
    is_arc = "move > 1" if system == HYBRID_R1 else f"(move > 1 AND move < {n_move})"
    reduce_option = "" if system == HYBRID_R1 else f", {{'c': c_d, 'm': {n_move}}}"
    focus = f"""SELECT * EXCLUDE (c_s, c_d, c_l, c_r, g_l, g_r), len(stack) AS sz, wptr AS n0, coalesce(stack[len(stack)], 0) AS s0,
          CASE WHEN len(stack) > 1 THEN stack[len(stack) - 1] ELSE 0 END AS s1,
          coalesce(heads[wptr], 0) AS gn, coalesce(heads[stack[len(stack)]], 0) AS gs,
          coalesce(head[stack[len(stack)]], 0) AS h0,
          len(list_filter(stack, lambda x: heads[x] = wptr AND head[x] = 0)) AS n0l,
          len(list_filter(heads[wptr : n], lambda x: x = coalesce(stack[len(stack)], 0))) AS s0r
        FROM {name} WHERE step < 2 * n - 2"""
    costs = ", ".join(f"CASE WHEN {legal[k]} THEN {cost[k]} ELSE 32767 END AS c_{k}" for k in "sdlr")
    priced = f"""SELECT *, {costs},
          CASE WHEN ({legal['l']}) AND gs = n0 AND s0 > 0 THEN deprels[s0] ELSE 0 END AS g_l,
          CASE WHEN ({legal['r']}) AND {right_dep} > 0 AND heads[{right_dep}] = {right_head}
               THEN deprels[{right_dep}] ELSE 0 END AS g_r FROM ({focus})"""
    chosen = f"""SELECT *, list_min([{{'c': c_s, 'm': 1}}, {{'c': c_l, 'm': CASE WHEN g_l > 1 THEN 2 * g_l - 2 ELSE 2 END}},
          {{'c': c_r, 'm': CASE WHEN g_r > 1 THEN 2 * g_r - 1 ELSE 3 END}}{reduce_option}]) AS best FROM ({priced})"""
    moved = f"SELECT *, best.m AS next_move, best.c AS next_cost FROM ({chosen})"
    arc = f"""SELECT * EXCLUDE (move, cost), next_move AS move, next_cost AS cost FROM ({moved})"""
    placed = f"""SELECT *, CASE WHEN NOT ({is_arc}) THEN 0 WHEN move % 2 = 0 THEN s0 ELSE {right_dep} END AS dep,
          CASE WHEN move % 2 = 0 THEN n0 ELSE {right_head} END AS gov FROM ({arc})"""
    return f"""{name} AS (
      SELECT sent_id, n, heads, deprels, upos, 0 AS step, [CAST(1 AS BIGINT)] AS stack, CAST(2 AS BIGINT) AS wptr,
        list_transform(range(0, n), lambda x: CAST(0 AS BIGINT)) AS head,
        list_transform(range(0, n), lambda x: CAST(1 AS BIGINT)) AS deprel,
        CAST(0 AS BIGINT) AS move, CAST(0 AS BIGINT) AS cost,
        CAST(0 AS BIGINT) AS c_s, CAST(0 AS BIGINT) AS c_d, CAST(0 AS BIGINT) AS c_l, CAST(0 AS BIGINT) AS c_r,
        CAST(0 AS BIGINT) AS g_l, CAST(0 AS BIGINT) AS g_r FROM {source}
      UNION ALL
      SELECT sent_id, n, heads, deprels, upos, step + 1,
        CASE WHEN {pushes} THEN list_append(stack, n0) ELSE stack[1 : sz - 1] END,
        CASE WHEN {pushes} THEN n0 + 1 ELSE n0 END,
        CASE WHEN dep = 0 THEN head ELSE list_transform(head, lambda x, i: CASE WHEN i = dep THEN gov ELSE x END) END,
        CASE WHEN dep = 0 THEN deprel
             ELSE list_transform(deprel, lambda x, i: CASE WHEN i = dep THEN move // 2 + 1 ELSE x END) END,
        move, cost, c_s, c_d, c_l, c_r, g_l, g_r FROM ({placed}))"""


for _system in SYSTEMS:
    sql(
        "gold_moves" if _system == HYBRID_R1 else f"gold_moves_{_system}",
        """SELECT sent_id, any_value(n) AS n,
             coalesce(string_agg(CAST(move AS VARCHAR), ' ' ORDER BY step) FILTER (step > 0), '') AS moves,
             CAST(sum(cost) AS BIGINT) AS cost,
             array_to_string(max({'s': step, 'v': head}).v, ' ') AS heads,
             array_to_string(max({'s': step, 'v': deprel}).v, ' ') AS deprels FROM run GROUP BY sent_id""",
        "nested",
        extra=_system_sql(_system, "run", "nested"),
    )

_LEGAL_COUNTS = "\nUNION ALL ".join(
    f"""SELECT n, count(*) AS n_states, count(*) FILTER (c_s < 32767) AS n_shift, count(*) FILTER (c_d < 32767) AS n_reduce,
        count(*) FILTER (c_l < 32767) AS n_left, count(*) FILTER (c_r < 32767) AS n_right, '{s}' AS system
        FROM run_{s} WHERE step > 0 GROUP BY n"""
    for s in SYSTEMS
)
sql(
    "legal_moves",
    _LEGAL_COUNTS,
    "tangled",
    extra=",\n".join(_system_sql(s, f"run_{s}", "tangled") for s in SYSTEMS),
)
_RUN = _system_sql(HYBRID_R1, "run", "tangled")
# 36 labels per direction; left moves are 2, 4 .. 72, right moves 3, 5 .. 73
sql(
    "move_costs",
    """SELECT sent_id,
         CAST(sum(CASE WHEN c_s < 32767 THEN 1 ELSE 0 END + CASE WHEN c_l < 32767 THEN 36 ELSE 0 END
             + CASE WHEN c_r < 32767 THEN 36 ELSE 0 END) AS BIGINT) AS n_legal,
         CAST(sum(CASE WHEN c_s < 32767 THEN c_s ELSE 0 END
             + CASE WHEN c_l < 32767 THEN 36 * c_l + CASE WHEN g_l > 0 THEN 35 ELSE 0 END ELSE 0 END
             + CASE WHEN c_r < 32767 THEN 36 * c_r + CASE WHEN g_r > 0 THEN 35 ELSE 0 END ELSE 0 END) AS BIGINT) AS cost_sum,
         CAST(sum(CASE WHEN c_s < 32767 THEN c_s ELSE 0 END
             + CASE WHEN c_l < 32767 THEN 1332 * c_l + CASE WHEN g_l > 0 THEN 1332 - (2 * g_l - 2) ELSE 0 END ELSE 0 END
             + CASE WHEN c_r < 32767 THEN 1368 * c_r + CASE WHEN g_r > 0 THEN 1368 - (2 * g_r - 1) ELSE 0 END ELSE 0 END)
             AS BIGINT) AS weighted_sum
       FROM run WHERE step > 0 GROUP BY sent_id""",
    "tangled",
    extra=_RUN,
)
sql("apply_moves", "SELECT sent_id, true AS is_final, true AS rebuilt FROM tb", "tb")
sql(
    "unreachable_trees",
    """SELECT s.sent_id, n_roots, crosses, over_root, crosses OR over_root OR n_roots > 1 AS lost_hybrid_r1,
         crosses OR over_root AS lost_hybrid13
       FROM (SELECT sent_id, count(*) FILTER (thead = 0) AS n_roots FROM tangled_tt GROUP BY sent_id) s
       JOIN (SELECT x.sent_id,
           coalesce(bool_or(x.thead > 0 AND y.thead > 0 AND x.thead < y.thead AND y.thead < x.tok_id
                            AND x.tok_id < y.tok_id), false) AS crosses,
           coalesce(bool_or(x.thead > 0 AND y.thead = 0 AND x.thead < y.tok_id AND y.tok_id < x.tok_id), false) AS over_root
         FROM tangled_tt x JOIN tangled_tt y ON x.sent_id = y.sent_id GROUP BY x.sent_id) c ON s.sent_id = c.sent_id""",
    "tangled_tt",
)

# states before each move, with the anchors of the default templates
_ANCHORED = """anchored AS (SELECT *,
      coalesce(list_max(list_filter(range(1, n + 1), lambda d: d > s0 AND head[d] = s0)), 0) * CAST(s0 > 0 AS INT) AS s0r,
      coalesce(list_max(list_filter(range(1, n + 1), lambda d: d > s1 AND head[d] = s1)), 0) * CAST(s1 > 0 AS INT) AS s1r,
      coalesce(list_min(list_filter(range(1, n + 1), lambda d: d < n0 AND head[d] = n0)), 0) * CAST(n0 > 0 AS INT) AS n0l
    FROM (SELECT *, step + 1 AS nth, coalesce(stack[len(stack)], 0) AS s0,
        CASE WHEN len(stack) > 1 THEN stack[len(stack) - 1] ELSE 0 END AS s1,
        CASE WHEN wptr <= n THEN wptr ELSE 0 END AS n0, CASE WHEN wptr + 1 <= n THEN wptr + 1 ELSE 0 END AS n1
      FROM run WHERE step < 2 * n - 2))"""
sql(
    "feature_anchors",
    "SELECT sent_id, "
    + ", ".join(f"CAST(sum({a} * nth) AS BIGINT) AS {a}" for a in ("n0", "n0l", "n1", "s0", "s0r", "s1", "s1r"))
    + " FROM anchored GROUP BY sent_id",
    "tangled",
    extra=_RUN + ",\n" + _ANCHORED,
)


def _features_sql() -> str:
    """Sparse ids in template order: tags 17 wide, labels 37, counts and distances 10."""

    def tag(a):
        return f"CASE WHEN {a} > 0 THEN [upos[{a}]] ELSE [] END"

    def label(a):
        return f"CASE WHEN {a} > 0 THEN [deprel[{a}]] ELSE [] END"

    def labels(a, op):
        found = f"list_filter(range(1, n + 1), lambda d: d {op} {a} AND head[d] = {a})"
        return f"CASE WHEN {a} > 0 THEN list_transform({found}, lambda d: deprel[d]) ELSE [] END"

    def count(a, op):
        found = f"list_filter(range(1, n + 1), lambda d: d {op} {a} AND head[d] = {a})"
        return f"CASE WHEN {a} > 0 THEN [least(len({found}) + 1, 10)] ELSE [] END"

    gap = "CASE WHEN s0 > 0 AND n0 > 0 AND n0 > s0 THEN [least(n0 - s0, 10)] ELSE [] END"
    parts = [
        (17, tag("s1")), (37, labels("s1", "<")), (10, count("s1", "<")), (37, labels("s1", ">")),
        (10, count("s1", ">")), (37, label("s1r")),
        (17, tag("s0")), (37, labels("s0", "<")), (37, labels("s0", ">")), (10, count("s0", "<")),
        (10, count("s0", ">")), (10, gap), (37, label("s0r")),
        (37, label("n0l")),
        (17, tag("n0")), (37, labels("n0", "<")), (10, count("n0", "<")),
        (17, tag("n1")),
    ]
    out, base = [], 0
    for width, ids in parts:
        out.append(f"list_transform({ids}, lambda x: CAST(x + {base - 1} AS BIGINT))")
        base += width
    return "list_concat(" + ", ".join(out) + ")"


sql(
    "transition_features",
    f"""SELECT sent_id, CAST(sum(len(ids)) AS BIGINT) AS n_active,
          CAST(sum(coalesce(list_sum(ids), 0) * nth) AS BIGINT) AS id_sum
        FROM (SELECT sent_id, nth, {_features_sql()} AS ids FROM anchored) GROUP BY sent_id""",
    "tangled",
    extra=_RUN + ",\n" + _ANCHORED,
)


def _dense_sql() -> str:
    """Vectors of the words in template order: contexts, then the word, for each of four anchors."""

    def word(a):
        t, zeros = f"upos[{a}]", "[0, 0, 0, 0, 0, 0, 0]"
        return f"""CASE WHEN {a} > 0 THEN [{t} * {a} % 5, {a} % 3, (n - {a}) % 5, {t} % 3, {t}, {a}, n - {a}] ELSE {zeros} END"""

    return "list_concat(" + ", ".join(map(word, ("s1", "s0", "n0", "n1"))) + ")"


_DENSE = f"featured AS (SELECT sent_id, nth, {_features_sql()} AS ids, {_dense_sql()} AS dense FROM anchored)"
sql(
    "dense_features",
    """SELECT sent_id, CAST(sum(len(ids)) AS BIGINT) AS n_active, CAST(sum(coalesce(list_sum(ids), 0) * nth) AS BIGINT) AS id_sum,
         CAST(sum(list_sum(list_transform(dense, lambda x, j: x * j)) * nth) AS BIGINT) AS dense_sum FROM featured GROUP BY sent_id""",
    "tangled",
    extra=_RUN + ",\n" + _ANCHORED + ",\n" + _DENSE,
)


def _hidden_sql(k: int) -> str:
    weight = f"((7 * (i) + {3 * k}) % 11 - 5)"
    sparse = f"coalesce(list_sum(list_transform(ids, lambda i: {weight})), 0)"
    # the vectors follow the sparse features
    dense = f"list_sum(list_transform(dense, lambda x, j: x * {weight.replace('(i)', '(j + SPARSE - 1)')}))"
    return f"1 / (1 + exp(-({k} / CAST(8 AS DOUBLE) + ({sparse} + {dense}) / CAST(64 AS DOUBLE)))) AS h{k}"


def _output_sql(m: int) -> str:
    terms = " + ".join(f"h{k} * {((5 * k + m) % 7 - 3) / 4}" for k in range(4))
    return f"round(CAST(sum(CAST({m / 16} AS DOUBLE) + {terms}) AS DOUBLE), 4) AS out_{m + 1}"


sql(
    "perceptron_scores",
    f"""SELECT sent_id, {", ".join(map(_output_sql, range(3)))}
        FROM (SELECT sent_id, {", ".join(map(_hidden_sql, range(4)))} FROM featured) GROUP BY sent_id""".replace(
        "SPARSE", str(4 * 17 + 8 * 37 + 6 * 10)
    ),
    "tangled",
    extra=_RUN + ",\n" + _ANCHORED + ",\n" + _DENSE,
)
sql(
    "distinct_states",
    """SELECT n, CAST(sum(c) AS BIGINT) AS n_states, count(*) AS n_distinct, max(c) AS max_copies FROM (
         SELECT n, stack, wptr, head, deprel, count(*) AS c FROM run WHERE step < 2 * n - 2 GROUP BY ALL) GROUP BY n""",
    "tangled",
    extra=_RUN,
)

# ---- models: what SQL can say about them

sql(
    "word_vectors",
    """SELECT word, 16 AS size, true AS whole FROM topv WHERE id > 3
       UNION ALL SELECT '<unk>', 16, true WHERE EXISTS (
         SELECT 1 FROM toks WHERE word = '<unk>' OR word NOT IN (SELECT word FROM topv))""",
    "topv",
    "toks",
)
sql(
    "train_moves",
    """SELECT CAST(sum(c) AS BIGINT) AS n_rows, round(max(c) / sum(c), 6) AS majority, true AS beats_majority FROM (
         SELECT move, count(*) AS c FROM run WHERE step > 0 AND n BETWEEN 2 AND 64 GROUP BY move)""",
    "nested",
    extra=_system_sql(HYBRID_R1, "run", "nested"),
)
sql(
    "beam_step",
    """SELECT sent_id, CAST(slot AS INT) AS slot, 1 AS parent, CAST(move AS INT) AS move, CAST(score AS DOUBLE) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, move) AS slot FROM (
           SELECT sent_id, move, (31 * move + 17 * upos[1] + 7 * upos[2] + 13 * n) % 101 AS score
           FROM nested, range(1, 74) r(move) WHERE n > 1 AND (move = 1 OR move % 2 = 0)))
       WHERE slot <= 4""",
    "nested",
)


def _beam_sql(source: str, score: str, beam: int) -> str:
    """Recursive part ``beam``: the members of each sentence's beam after every step, in the hybrid system of one root.

    ``score`` is the score of move ``m``. ``alive`` tells whether some member has cost nothing; a beam without goes no
    further. ``free`` is the score that the first such member had with its first free move, ``free_next`` that of a member.
    """
    focus = """SELECT *, len(stack) AS sz, wptr AS n0, coalesce(stack[len(stack)], 0) AS s0,
          CASE WHEN len(stack) > 1 THEN stack[len(stack) - 1] ELSE 0 END AS s1,
          coalesce(heads[wptr], 0) AS gn, coalesce(heads[stack[len(stack)]], 0) AS gs,
          len(list_filter(stack, lambda x: heads[x] = wptr)) AS n0l,
          len(list_filter(heads[wptr : n], lambda x: x = coalesce(stack[len(stack)], 0))) AS s0r,
          coalesce(upos[stack[len(stack)]], 0) AS t0, coalesce(upos[wptr], 0) AS tn
        FROM beam WHERE alive AND step < 2 * n - 2"""
    priced = f"""SELECT *, n0l + CASE WHEN gn <> s0 AND list_contains(stack, gn) THEN 1 ELSE 0 END
            + CASE WHEN gn = 0 AND sz > 0 THEN 1 ELSE 0 END AS c_s,
          s0r + CASE WHEN gs > n0 OR (sz = 1 AND gs = 0) OR (sz > 1 AND gs = s1) THEN 1 ELSE 0 END AS c_l,
          s0r + CASE WHEN gs >= n0 THEN 1 ELSE 0 END AS c_r,
          CASE WHEN gs = n0 AND s0 > 0 THEN deprels[s0] ELSE 0 END AS g_l,
          CASE WHEN gs = s1 AND s0 > 0 THEN deprels[s0] ELSE 0 END AS g_r FROM ({focus})"""
    cost = """CASE WHEN m = 1 THEN c_s WHEN m % 2 = 0 THEN c_l + CASE WHEN g_l > 0 AND m // 2 + 1 <> g_l THEN 1 ELSE 0 END
                   ELSE c_r + CASE WHEN g_r > 0 AND m // 2 + 1 <> g_r THEN 1 ELSE 0 END END"""
    legal = "CASE WHEN m = 1 THEN n0 <= n WHEN m % 2 = 0 THEN n0 <= n AND sz > 0 ELSE sz > 1 END"
    moves = f"""SELECT *, list_transform(list_filter(range(1, 74), lambda m: {legal}),
          lambda m: {{'m': m, 'c': {cost}}}) AS moves FROM ({priced})"""
    scored = f"""SELECT *, list_transform(moves, lambda x: {{'neg': -(score + {score}), 'm': x.m, 'c': cost + x.c}}) AS entries FROM ({moves})"""
    best = f"""SELECT * EXCLUDE (free), list_sort(entries)[1:{beam}] AS top,
          CASE WHEN cost = 0 THEN list_min(list_transform(list_filter(entries, lambda e: e.c = 0), lambda e: {{'m': e.m, 's': -e.neg}})).s END AS free_next
        FROM ({scored})"""
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY pick.neg, slot, pick.m) AS place,
          arg_min(coalesce(free_next, 'nan'), slot) FILTER (cost = 0) OVER (PARTITION BY sent_id) AS free
        FROM (SELECT *, unnest(top) AS pick FROM ({best}))"""
    kept = f"""SELECT * EXCLUDE (alive), bool_or(pick.c = 0) OVER (PARTITION BY sent_id) AS alive, pick.m AS m,
          CASE WHEN pick.m = 1 THEN 0 ELSE s0 END AS dep, CASE WHEN pick.m % 2 = 0 THEN n0 ELSE s1 END AS gov
        FROM ({ranked}) WHERE place <= {beam}"""
    return f"""beam AS (
      SELECT sent_id, n, heads, deprels, upos, 0 AS step, CAST(1 AS BIGINT) AS slot, [CAST(1 AS BIGINT)] AS stack, CAST(2 AS BIGINT) AS wptr,
        list_transform(range(0, n), lambda x: CAST(0 AS BIGINT)) AS head,
        list_transform(range(0, n), lambda x: CAST(1 AS BIGINT)) AS deprel,
        CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS cost, true AS alive, CAST(NULL AS DOUBLE) AS free FROM {source}
      UNION ALL
      SELECT sent_id, n, heads, deprels, upos, step + 1, place,
        CASE WHEN m = 1 THEN list_append(stack, n0) ELSE stack[1 : sz - 1] END, CASE WHEN m = 1 THEN n0 + 1 ELSE n0 END,
        CASE WHEN dep = 0 THEN head ELSE list_transform(head, lambda x, i: CASE WHEN i = dep THEN gov ELSE x END) END,
        CASE WHEN dep = 0 THEN deprel ELSE list_transform(deprel, lambda x, i: CASE WHEN i = dep THEN m // 2 + 1 ELSE x END) END,
        -pick.neg, pick.c, alive, free FROM ({kept}))"""


_RULE = "(31 * x.m + 17 * t0 + 7 * tn + 13 * n + 5 * sz) % 101"
# no gold moves are needed here, so the search never stops early
sql(
    "beam_parse",
    """SELECT sent_id, score, array_to_string(head, ' ') AS heads, array_to_string(deprel, ' ') AS deprels
       FROM beam WHERE slot = 1 AND step = 2 * n - 2""",
    "nested",
    extra=_beam_sql("nested", f"CAST({_RULE} AS DOUBLE)", 4).replace("WHERE alive AND step", "WHERE step"),
)
sql(
    "beam_search_loss",
    """SELECT sent_id, any_value(step) AS steps, NOT any_value(alive) AS early_stop,
         round(CASE WHEN any_value(n) = 1 THEN 0 WHEN any_value(alive) THEN top + ln(sum(exp(score - top))) - gold
              WHEN isnan(any_value(free)) THEN 0
              ELSE greatest(top, any_value(free)) + ln(sum(exp(score - greatest(top, free))) + exp(any_value(free) - greatest(top, any_value(free))))
                   - any_value(free) END, 6) AS loss
       FROM (SELECT *, max(score) OVER w AS top, arg_min(score, slot) FILTER (cost = 0) OVER w AS gold FROM beam
             WHERE step = 2 * n - 2 OR NOT alive WINDOW w AS (PARTITION BY sent_id))
       GROUP BY sent_id, top, gold""",
    "nested",
    extra=_beam_sql("nested", f"(({_RULE}) % 37 - 20 * x.c) / CAST(8 AS DOUBLE)", 4),
)
sql(
    "parse_corpus",
    """SELECT lang, CAST(sum(n) AS BIGINT) AS n_words, true AS beats_commonest FROM nested GROUP BY lang""",
    "nested",
)

# ---- streaming

sql("stream_tokens", "SELECT line, n, array_to_string(words, ' ') AS words FROM sents", "sents")
sql("stream_word_count", "SELECT word, n FROM counts", "counts")
sql(
    "stream_batches",
    """SELECT n + 2 AS seq_len, count(*) // 25 AS n_batches, count(*) // 25 * 25 AS n_seq FROM sents
       GROUP BY n HAVING count(*) >= 25""",
    "sents",
)
