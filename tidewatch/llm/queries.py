"""The registered queries of this package over the given tables, with their SQL where SQL can say the same."""

import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm import (
    edit_embedding, extendible, language, line_alignment, merkle, mixing, packing, quality, repetition, simhash,
    url_templates, warc, whitening,
)
from tidewatch.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NS = sorted({*repetition.TOP_PERCENT, *repetition.REPEATED_PERCENT, repetition.WINDOW_WORDS})


def _repetition_sql() -> str:
    tops = "".join(f", coalesce(max(chars) FILTER (kind = 'top' AND n = {n}), 0)::BIGINT AS top_{n}gram_chars"
                   for n in repetition.TOP_PERCENT)
    dups = "".join(f", coalesce(max(chars) FILTER (kind = 'dup' AND n = {n}), 0)::BIGINT AS dup_{n}gram_chars"
                   for n in repetition.REPEATED_PERCENT)
    failed = " OR ".join([
        f"100 * n_dup_lines > {repetition.LINE_PERCENT} * n_lines",
        f"100 * dup_line_chars > {repetition.LINE_CHARACTER_PERCENT} * word_chars",
        *[f"100 * top_{n}gram_chars > {p} * word_chars" for n, p in repetition.TOP_PERCENT.items()],
        *[f"100 * dup_{n}gram_chars > {p} * word_chars" for n, p in repetition.REPEATED_PERCENT.items()]])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
pos AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
word AS (SELECT r, i, length(ws[i]) AS chars FROM pos),
gram AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM pos, (SELECT unnest({_NS}) AS n) WHERE i + n - 1 <= len(ws)),
counted AS (SELECT r, n, g, count(*) AS c, min(i) AS first FROM gram GROUP BY ALL HAVING count(*) > 1),
best AS (SELECT r, n, arg_max(g, c * 10000000 - first) AS g FROM counted GROUP BY ALL),
hit AS (SELECT 'dup' AS kind, gram.* FROM gram SEMI JOIN counted USING (r, n, g)
  UNION ALL SELECT 'top' AS kind, gram.* FROM gram SEMI JOIN best USING (r, n, g)),
place AS (SELECT DISTINCT kind, r, n, unnest(range(i, i + n)) AS i FROM hit),
cover AS (SELECT kind, r, n, count(*) AS words, sum(chars) AS chars FROM place JOIN word USING (r, i) GROUP BY ALL),
wide AS (SELECT r, coalesce(max(words) FILTER (kind = 'dup' AND n = {repetition.WINDOW_WORDS}), 0)::BIGINT
  AS n_repeat_words{tops}{dups} FROM cover GROUP BY r),
line AS (SELECT r, l, count(*) AS c, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
lines AS (SELECT r, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines,
  sum((c - 1) * chars)::BIGINT AS dup_line_chars FROM line GROUP BY r),
total AS (SELECT r, sum(chars)::BIGINT AS word_chars FROM word GROUP BY r),
counts AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
  {', '.join(f'coalesce(top_{n}gram_chars, 0) AS top_{n}gram_chars' for n in repetition.TOP_PERCENT)},
  {', '.join(f'coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars' for n in repetition.REPEATED_PERCENT)}
  FROM d LEFT JOIN wide USING (r) LEFT JOIN lines USING (r) LEFT JOIN total USING (r)),
judged AS (SELECT *, n_words < {repetition.MIN_WORDS}
  OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  ({failed}) AS repetition_failed FROM counts)
SELECT *, NOT base_failed AND NOT repetition_failed AS kept FROM judged"""


@query("op1_repetition_rules", _repetition_sql())
def op1(spark, folder):
    return repetition.repetition(table(spark, folder, "documents"))


@query("op2_balanced_mix")
def op2(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


#: The last number of a url's path names a document: its label, where it has one, is the page's.
_PAGE_NUMBER = r"^[^?#]*/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)"


#: Levels of the tree in the SQL; the operator has as many as the data need.
_URL_LEVELS = 4


def _url_sql() -> str:
    rule = verdict = "NULL"
    for name, says in sorted(url_templates.RULES, key=lambda r: (len(r[0]), r[0])):
        host, _, path = name.partition("/")
        fits = f"((r.host = '{host}' OR r.host LIKE '%.{host}') AND starts_with(path, '/{path}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{name}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    ctes = []
    for k in range(1, _URL_LEVELS + 1):
        ctes.append(f"""cut{k} AS (SELECT host, steps, split_part(tail, '/', 1) AS seg, sum(labelled) AS n, min(tail) AS lo, max(tail) AS hi
  FROM tree{k - 1} WHERE open GROUP BY ALL),
named{k} AS (SELECT host, steps, seg, CASE WHEN n >= least THEN seg ELSE '*' END AS name,
  sum(n) OVER w >= least AND min(lo) OVER w <> max(hi) OVER w AS grows FROM cut{k}, lim WINDOW w AS (PARTITION BY host, steps)),
tree{k} AS (SELECT s.host, shape, labelled, bad, CASE WHEN grows THEN list_append(s.steps, name) ELSE s.steps END AS steps,
  CASE WHEN contains(tail, '/') THEN substr(tail, instr(tail, '/') + 1) ELSE '' END AS tail, coalesce(grows, false) AS open
  FROM tree{k - 1} s LEFT JOIN named{k} f ON s.open AND f.host = s.host AND f.steps = s.steps AND f.seg = split_part(tail, '/', 1))""")
    ctes.append(f"leaf{_URL_LEVELS + 1} AS (SELECT host, steps, steps AS merged, sum(labelled)::BIGINT AS labelled, "
                f"sum(bad)::BIGINT AS bad FROM tree{_URL_LEVELS} GROUP BY ALL)")
    for k in range(_URL_LEVELS, 0, -1):
        ctes.append(f"""branch{k} AS (SELECT host, merged[1:{k - 1}] AS above, merged[{k}] AS name, sum(labelled)::DOUBLE AS n, sum(bad)::DOUBLE AS b
  FROM leaf{k + 1} WHERE len(merged) >= {k} GROUP BY ALL),
fate{k} AS (SELECT *, sum(n) OVER w AS nn, sum(b) OVER w AS bb FROM branch{k} WINDOW w AS (PARTITION BY host, above)),
leaf{k} AS (SELECT l.host, steps, labelled, bad, CASE WHEN f.host IS NULL OR
    (b * nn - bb * n) * (b * nn - bb * n) > {url_templates.DEVIATIONS ** 2} * bb * (nn - bb) * n THEN merged
  ELSE list_concat(list_append(above, '*'), merged[{k + 1}:]) END AS merged
  FROM leaf{k + 1} l LEFT JOIN fate{k} f ON len(merged) >= {k} AND f.host = l.host AND f.above = merged[1:{k - 1}] AND f.name = merged[{k}])""")
    trees = ",\n".join(ctes)
    return rf"""
WITH page AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      '{url_templates.UPPER}', '{url_templates.LOWER}') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    try_cast(nullif(regexp_extract(url, '{_PAGE_NUMBER}', 1), '') AS BIGINT) AS number FROM pages),
lab AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
row AS (SELECT p.*, lab.bad AS is_bad, regexp_replace(regexp_replace(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/+', '/', 'g'),
    '^/|/$', '', 'g') AS shape FROM page p LEFT JOIN lab ON p.number = lab.doc_id),
shapes AS (SELECT host, shape, count(is_bad) AS labelled, count(*) FILTER (is_bad) AS bad FROM row GROUP BY ALL),
tot AS (SELECT sum(labelled)::BIGINT AS a, sum(bad)::BIGINT AS b FROM shapes),
lim AS (SELECT CASE WHEN a > 0 THEN {url_templates.PRIOR} * abs(a - 2 * b) // a + 1 ELSE 1 END AS least FROM tot),
tree0 AS (SELECT *, []::VARCHAR[] AS steps, shape AS tail, true AS open FROM shapes),
{trees},
summed AS (SELECT host, merged, sum(labelled)::BIGINT AS template_labelled, sum(bad)::BIGINT AS template_bad FROM leaf1 GROUP BY ALL),
judged AS (SELECT s.host, t.shape, template_labelled, template_bad,
  '/' || regexp_replace(array_to_string(s.merged, '/'), '/+$', '') AS template,
  a > 0 AND 2 * (template_bad * a + {url_templates.PRIOR} * b) > a * (template_labelled + {url_templates.PRIOR}) AS rejected
  FROM tree{_URL_LEVELS} t JOIN leaf1 l ON l.host = t.host AND l.steps = t.steps
  JOIN summed s ON s.host = l.host AND s.merged = l.merged, tot)
SELECT page_id, r.host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict,
  template, template_labelled, template_bad
FROM row r JOIN judged j ON r.host = j.host AND r.shape = j.shape"""


@query("op3_url_templates", _url_sql())
def op3(spark, folder):
    labels = (table(spark, folder, "labels").groupBy(F.col("doc_id").alias("_number"))
              .agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("_label")))
    number = F.expr("try_cast(nullif(_digits, '') AS BIGINT)")
    pages = (table(spark, folder, "pages").select("page_id", "url", F.regexp_extract("url", _PAGE_NUMBER, 1).alias("_digits"))
             .withColumn("_number", number).join(labels, "_number", "left"))
    return url_templates.judge(pages, F.col("_label"))


_LEAST = warc.LEAST_SHARED_BYTES


@query("op4_seekable_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {_LEAST} AND page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {_LEAST} AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM g""")
def op4(spark, folder):
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), path)
    return warc.read_archive(spark.read.parquet(path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_quadratic_quality")
def op5(spark, folder):
    scored = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query("op6_simhash_bk")
def op6(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op7_concatenate_and_cut")
def op7(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), *_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op8_edit_embedding")
def op8(spark, folder):
    return edit_embedding.compare_edits(table(spark, folder, "documents"))


@query("op9_extendible_shards", f"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, {extendible.HASH_BITS // 4}))::BIGINT),
    {extendible.HASH_BITS}, '0') AS bits FROM documents),
p AS (SELECT r, doc_id, bytes, depth, substr(bits, 1, depth) AS shard
  FROM r, (SELECT unnest(range(0, {extendible.HASH_BITS} + 1))::INTEGER AS depth)),
s AS (SELECT depth, shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
f AS (SELECT p.*, shard_bytes, shard_rows, row_number() OVER (PARTITION BY r ORDER BY p.depth) AS k
  FROM p JOIN s ON p.depth = s.depth AND p.shard = s.shard
  WHERE shard_bytes <= {extendible.SHARD_BYTES} OR p.depth = {extendible.HASH_BITS})
SELECT doc_id, bytes, shard, depth, shard_bytes, shard_rows, shard_bytes > {extendible.SHARD_BYTES} AS oversize FROM f WHERE k = 1""")
def op9(spark, folder):
    return extendible.shard_documents(table(spark, folder, "documents"))


@query("op10_line_alignment")
def op10(spark, folder):
    return line_alignment.report(table(spark, folder, "documents"))


@query("op11_embedding_whitening")
def op11(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


#: CRC-32 of the ASCII text ``s``, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _merkle_sql() -> str:
    def leaf(**changed):
        return "sha256(" + " || ".join(
            f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')"
            for v in (changed.get(c, c) for c in merkle.COLUMNS)) + ")"

    return f"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS key, {leaf()} AS leaf,
  {leaf(n_chars="n_chars::HUGEINT + 1")} AS other, {_CRC32} % 7 = 0 AS tampered FROM (SELECT *, doc_id::VARCHAR AS s FROM documents)),
n0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS c FROM d),
up AS (SELECT key, 0 AS lvl, i, c, leaf AS h FROM n0
  UNION ALL SELECT key, lvl + 1, i // 2, (c + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE c > 1 GROUP BY key, lvl, c, i // 2),
sub AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS c FROM up WHERE c = 1),
top AS (SELECT 0 AS lvl, i, c, h FROM sub
  UNION ALL SELECT lvl + 1, i // 2, (c + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE c > 1 GROUP BY lvl, c, i // 2),
own AS (SELECT r, up.lvl, up.i FROM n0 JOIN up ON up.key = n0.key AND up.i = n0.i >> up.lvl WHERE up.c > 1),
far AS (SELECT r, top.lvl, top.i FROM n0 JOIN sub USING (key) JOIN top ON top.i = sub.i >> top.lvl WHERE top.c > 1),
step AS (SELECT own.r, own.lvl, own.i, up.h FROM own JOIN n0 USING (r) LEFT JOIN up ON up.key = n0.key AND up.lvl = own.lvl AND up.i = xor(own.i, 1)
  UNION ALL SELECT far.r, 100 + far.lvl, far.i, top.h FROM far LEFT JOIN top ON top.lvl = far.lvl AND top.i = xor(far.i, 1)),
place AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM step),
fold AS (SELECT r, 0 AS k, CASE WHEN tampered THEN other ELSE leaf END AS h FROM n0
  UNION ALL SELECT r, p.k, sha256(CASE WHEN p.i % 2 = 1 THEN coalesce(p.h, '') || fold.h ELSE fold.h || coalesce(p.h, '') END)
  FROM fold JOIN place p USING (r) WHERE p.k = fold.k + 1),
last AS (SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r),
proof AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256 FROM step GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM n0 JOIN sub USING (key) JOIN last USING (r) LEFT JOIN proof USING (r), (SELECT h FROM top WHERE c = 1) t"""


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark, folder):
    return merkle.audit(table(spark, folder, "documents"))


@query("op13_string_kernel_language")
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    # The id is carried beside the answer: held_out is no input of it.
    return language.identify(docs, language.fit(docs)).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score")
