"""Registered queries of the text operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilohour.llm import bpe, chat, chunk_bpe, decontam, langid, line_dedup, merkle, minhash, prefix_trie, spelling, toxicity, warc, wrapper
from kilohour.llm.common import held_out, shared_name, table
from kilohour.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return wrap


@query(
    "op1_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, u.i, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
             LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS i) u
    ), repeated AS (
        SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
    )
    SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.first_doc <> l.doc_id) AS n_dropped,
           sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE r.key IS NULL OR r.first_doc = l.doc_id), '')) AS kept_sha256
    FROM lines l LEFT JOIN repeated r ON l.key = r.key GROUP BY l.doc_id
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_lines(docs, line_dedup.indexed(docs), digest=True)


_CHAT = chat.Template()
# the overhead of a turn, and a pattern for what is replaced by two characters, both taken from the template
_LENGTHS = " ".join(f"WHEN '{r}' THEN {len(m.opening) + len(m.closing)}" for r, m in _CHAT.roles.items())
_ESCAPED = "|".join([r"\\", *(c.replace("[", r"\[").replace("]", r"\]") for c in _CHAT.controls())])


@query(
    "op2_chat_format",
    rf"""
    WITH turns AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(CASE role {_LENGTHS} END + length(regexp_replace(text, '{_ESCAPED}', 'xx', 'g'))) AS BIGINT) AS formatted_chars,
           bool_and(ok) AS valid
    FROM (SELECT *, CASE coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '')
              WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE role = 'user' END AS ok FROM turns)
    GROUP BY conv_id
    """,
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe), _CHAT), _CHAT)


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against a plain reading of the article element in tests/llm."""
    return wrapper.extract_pages(table(spark, sf_dir, "pages"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op4_decontamination",
    f"""
    WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS gram
        FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
    ), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    places AS (
        SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
    ), hit AS (
        SELECT doc_id, places.n, i, item_id FROM places JOIN windows ON places.n = windows.n AND places.gram = windows.gram
    ), covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id
    ), named AS (
        SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op5_fingerprint")
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against a plain tree in tests/llm."""
    return merkle.compare(table(spark, sf_dir, "documents"))


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against all pairs by brute force in tests/llm."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked for held-out accuracy and against a plain scorer in tests/llm."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked for held-out accuracy and against a plain Viterbi in tests/llm."""
    docs = table(spark, sf_dir, "documents")
    labelled = langid.predict(docs, langid.fit(docs), ["doc_id"])
    return labelled.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query(
    "op9_warc",
    """
    WITH facts AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), best AS (SELECT payload_digest, max(page_id) AS top FROM facts WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, f.payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN top <> page_id THEN top END AS refers_to
    FROM facts f LEFT JOIN best b ON f.payload_digest = b.payload_digest
    """,
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"), shared_name(spark, "warc"))
    return archive.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against the tiktoken library and byte by byte in tests/llm."""
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


# crc32 in SQL: the table of the reversed polynomial, and a fold over the bytes of a text
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"""
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
# UTF-8 bytes of a text below U+0100, the only ones that occur here
_BYTES = """flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
        ELSE [194 + CAST(unicode(c) >= 192 AS BIGINT), 128 + unicode(c) % 64] END))"""


@query(
    "op11_prefix_trie",
    rf"""
    WITH crc AS ({_CRC_TABLE}),
    own AS (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS seq
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), dealt AS (SELECT conv_id, seq, {_CRC.format(bytes=_BYTES.format(text="CAST(conv_id AS VARCHAR)"))} % 6 AS h FROM own, crc),
    made AS (
        SELECT c.conv_id, list_concat(coalesce(list_slice(b.seq, 1, c.h), []), list_slice(c.seq, c.h + 1, len(c.seq))) AS seq
        FROM dealt c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
    ), prefixes AS (
        SELECT list_slice(seq, 1, d) AS p, d AS depth, conv_id, len(seq) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(seq[d].text) END AS size
        FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM made)
    ), nodes AS (
        SELECT p, depth, list_slice(p, 1, depth - 1) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM prefixes GROUP BY p, depth
    ), kids AS (SELECT above AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
    below AS (
        SELECT list_slice(n.p, 1, d) AS p, sum((n_convs - 1) * size) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN kids ON kids.p = n.p GROUP BY list_slice(n.p, 1, d)
    )
    SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below ON below.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN nodes a ON n.depth > 0 AND a.p = n.above
    """,
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


@query("op12_chunk_bpe")
def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against the tokenizers library in tests/llm."""
    return chunk_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


@query(
    "op13_spelling",
    rf"""
    WITH RECURSIVE crc AS ({_CRC_TABLE}),
    runs AS (
        SELECT doc_id, run, count(*) AS times FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.RUN}')) AS run FROM documents)
        WHERE length(run) >= 6 GROUP BY doc_id, run
    ), hashed AS (
        SELECT run, times, {_CRC.format(bytes=_BYTES.format(text="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs, crc
    ), words AS (
        SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                        ELSE run END AS word, times FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
    ), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    open AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places),
    near AS (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM open a JOIN open b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail WHERE a.word <> b.word
        UNION SELECT o.word, o.n, w.word, w.n FROM open o JOIN words w ON o.head || o.tail = w.word
        UNION SELECT w.word, w.n, o.word, o.n FROM open o JOIN words w ON o.head || o.tail = w.word
    ), best AS (
        SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
    ), formed AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
               CASE WHEN top >= 5 * w.n THEN (SELECT min(other) FROM near WHERE near.word = w.word AND other_n = top) END AS form
        FROM words w LEFT JOIN best USING (word)
    ), walked AS (
        SELECT word, word AS root, 0 AS steps FROM formed
        UNION ALL SELECT walked.word, f.form, steps + 1 FROM walked JOIN formed f ON f.word = walked.root WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
    FROM formed f JOIN (SELECT word, max_by(root, steps) AS root FROM walked GROUP BY word) r USING (word)
    """,
)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents")).where(F.length("run") >= 6)
    return spelling.variants(spelling.vocabulary(spelling.misspelt(found)))
