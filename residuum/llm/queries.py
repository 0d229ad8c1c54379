"""The queries of the subpackage: each binds one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm import chat, decontam, infill, langid, mixing, pieces, quality_model, quality_rules, repair, secret_scan, sharding, simhash, token_output
from residuum.llm.common import documents, new_path, stash


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = mixing.dealt(mixing.plan_mix(documents(spark, sf_dir)))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(stash(rows, "shard-sizes"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    token_output.write_tokens(documents(spark, sf_dir), folder, tokenizer_file(), end=2)
    found = token_output.digests(token_output.read_tokens(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    more = [r for r in quality_rules.RULES if r.name not in ("few_words", "repeated_windows")]  # those two are the base
    measured = quality_rules.measure(docs, "text", quality_rules.cheapest_first(docs, "text", more, known=("words", "lines", *quality_rules.MEASURES)))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~base_failed & F.col("rejected_by").isNull()
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_windows(chat.format_windows(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    window = F.struct("window", told.alias("told"), F.array_join("learnt", "").alias("learnt"))
    # the digest is of whole conversations, so here, unlike in the operator, each is put together
    whole = read.groupBy("conv").agg(F.array_sort(F.collect_list(window)).alias("w"), F.sum(F.size("turns")).alias("n_turns"), F.sum(F.length("formatted")).alias("formatted_chars"))
    told, learnt = F.array_join("w.told", ""), F.array_join("w.learnt", "")
    return whole.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2(told, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")


def held_out(doc_id) -> F.col:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")), F.col("text"), F.col("lang"))
    found = langid.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return quality_model.classify(documents(spark, sf_dir), pages, labels).withColumnRenamed("id", "doc_id")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), path), path)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(documents(spark, sf_dir).select("doc_id", "text"))
    again = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with the faults that the contract of ``op13_repair`` plants."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    told = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *filled, F.pmod(F.crc32(told.cast("binary")), F.lit(20)).alias("__d")).filter("__d != 0")
    text = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("__d") == 3, 2).otherwise(1))).alias("__k")).drop("__k")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = repair.read(damaged(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    shown = repair.attach(turns, repair.plan(turns)).withColumn("row", F.struct("at", repair.audit().alias("audit"), F.when(F.size("turns") > 0, told).alias("told")))
    # the digest is of whole conversations, so here, unlike in the operator, each is put together
    whole = shown.groupBy(F.col("key.conv").alias("c")).agg(*repair.counts(), F.array_sort(F.collect_list("row")).alias("rows"))
    whole = whole.withColumn("audit", F.array_join("rows.audit", "")).withColumn("repaired_sha256", F.sha2(F.array_join("rows.told", "\n"), 256)).drop("rows")
    every = conversations.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = every.join(whole, every["conv_id"].eqNullSafe(whole["c"]), "left")
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_windows": op2_chat_windows,
    "op3_simhash": op3_simhash,
    "op4_quality_model": op4_quality_model,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_shard": op8_shard,
    "op9_token_output": op9_token_output,
    "op10_secret_scan": op10_secret_scan,
    "op11_pieces": op11_pieces,
    "op12_infill": op12_infill,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_windows": r"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens FROM turns),
marked AS (SELECT *, pos = 1 AND role = 'system' AS sys FROM placed),
summed AS (
  SELECT *, sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER w AS upto,
         greatest(1, 512 - 128 - coalesce(max(CASE WHEN sys THEN tokens END) OVER w, 0)) AS room
  FROM marked WINDOW w AS (PARTITION BY conv ORDER BY pos ROWS UNBOUNDED PRECEDING)),
spanned AS (
  SELECT *, CASE WHEN sys THEN upto ELSE upto - tokens END AS since FROM summed),
starts(conv, s) AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT) FROM spanned WHERE NOT sys
  UNION ALL SELECT conv, CAST(next_ AS BIGINT) FROM (
    SELECT s.conv, s.s, greatest(min(k.upto), coalesce(max(CASE WHEN k.upto <= s.s + k.room + CASE WHEN s.s = 0 THEN 128 ELSE 0 END THEN k.upto END), 0)) AS next_, max(k.upto) AS total
    FROM starts s JOIN spanned k ON s.conv = k.conv AND NOT k.sys AND k.upto > s.s GROUP BY s.conv, s.s) WHERE next_ < total),
begun AS (SELECT k.conv, k.pos, max(s.s) AS span FROM spanned k JOIN starts s ON s.conv = k.conv AND NOT k.sys AND s.s <= k.since GROUP BY k.conv, k.pos),
keyed AS (
  SELECT p.*, b.span, 8 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\|(turn|end)\|>|/?s>|/?INST\])')) + 7 AS chars
  FROM spanned p LEFT JOIN begun b ON p.conv = b.conv AND p.pos = b.pos),
spans AS (SELECT conv, span, min(since) AS begin_ FROM keyed WHERE NOT sys GROUP BY conv, span),
shown AS (
  SELECT conv, chars FROM keyed WHERE NOT sys
  UNION ALL SELECT k.conv, k.chars FROM keyed k JOIN spans s ON k.conv = s.conv AND NOT k.sys AND k.upto <= s.begin_ AND s.begin_ - k.since <= 128
  UNION ALL SELECT k.conv, k.chars FROM keyed k LEFT JOIN spans s ON k.conv = s.conv WHERE k.sys),
size_ AS (SELECT conv, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv),
told AS (
  SELECT conv, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS learnt FROM keyed GROUP BY conv)
SELECT t.conv AS conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM told t JOIN size_ s ON t.conv = s.conv
""",
    "op5_quality_rules": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT rid, i, w[i : i + 4] AS five FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)),
twice AS (SELECT rid, unnest(list(i)) AS i FROM windows GROUP BY rid, five HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid),
measured AS (
  SELECT d.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS upper_,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS bangs, coalesce(c.n, 0) AS n_repeat_words
  FROM worded d LEFT JOIN covered c ON d.rid = c.rid),
based AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * len(lines)
         OR len(lines) >= 3 AND (100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\t]*[-*•‣▪]'))) > 90 * len(lines) OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\t\r]*$'))) > 30 * len(lines)) OR 2 * upper_ > letters OR 2 * bangs > n_words
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * letters < 3 * word_chars) AS kept
FROM based
""",
    "op7_mix_sources": """
WITH sized AS (
  SELECT doc_id AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
rows_ AS (SELECT id, source, size, count(*) AS repeats, size * count(*) AS words FROM sized GROUP BY id, source, size),
totals AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM totals),
weighed AS (
  SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM ranked),
levelled AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
         CAST(budget - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
levels AS (
  SELECT source, source_size, source_rank, budget,
         CAST(coalesce(sum(source_size) OVER (ORDER BY source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier,
         least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * w, CAST(cap AS DOUBLE))) AS target FROM levelled),
joined AS (
  SELECT r.id, r.source, r.size, r.repeats, r.words, l.source_size, l.source_rank, l.budget, l.earlier, l.target,
         md5('mix-0:' || coalesce(CAST(r.id AS VARCHAR), '')) AS h
  FROM rows_ r JOIN levels l ON r.source IS NOT DISTINCT FROM l.source),
numbered AS (SELECT *, unnest(range(1, repeats + 1)) AS k FROM joined),
served AS (SELECT *, CAST(sum(size) OVER (ORDER BY source_rank, h, id NULLS FIRST, size, k ROWS UNBOUNDED PRECEDING) AS BIGINT) - earlier AS served FROM numbered),
copies AS (
  SELECT *, CAST(epoch * source_size + served AS DOUBLE) / target AS finish
  FROM served, (SELECT unnest([0, 1, 2]) AS epoch) WHERE target > 0),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, source_rank, h, id NULLS FIRST, size, epoch, k ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT id, source, size, k, count(*) AS epochs FROM queue WHERE total <= budget GROUP BY id, source, size, k)
SELECT j.id AS doc_id, j.size, j.source_size, j.target, CAST(j.size * coalesce(t.epochs, 0) AS BIGINT) AS taken
FROM numbered j LEFT JOIN taken t ON j.id IS NOT DISTINCT FROM t.id AND j.source IS NOT DISTINCT FROM t.source AND j.size = t.size AND j.k = t.k
""",
    "op12_infill": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
formed AS (
  SELECT *, least(h1, h2) AS a, greatest(h1, h2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
    "op10_secret_scan": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT rid, 0 AS kind, 12 AS least_, string_split_regex(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps,
         regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS whole,
         regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS part FROM docs
  UNION ALL SELECT rid, 1, 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT rid, 2, 16, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM docs
  UNION ALL SELECT rid, 3, 16, string_split_regex(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+') FROM docs),
each_ AS (SELECT rid, kind, least_, i, length(gaps[i]) AS gap, length(whole[i]) AS size, length(part[i]) AS part, whole[i] AS token FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)),
placed AS (SELECT rid, kind, least_, part, token, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY i) - size AS start_, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY i) AS stop_ FROM each_),
spans AS (SELECT rid, kind, token, CAST(start_ AS BIGINT) AS start_, CAST(stop_ AS BIGINT) AS stop_ FROM placed WHERE part >= least_),
cores AS (
  SELECT rid, start_, stop_, token, CASE WHEN regexp_full_match(token, '[0-9a-fA-F]+(?:[-_][0-9a-fA-F]+)*') THEN translate(token, '-_', '') ELSE regexp_replace(token, '=+$', '') END AS core
  FROM spans WHERE kind = 3 AND regexp_matches(token, '[A-Za-z]')),
coded AS (
  SELECT *, CAST(length(core) AS DOUBLE) AS n, lower(core) AS low,
         CASE WHEN regexp_full_match(core, '[0-9a-f]+|[0-9A-F]+') THEN 0 WHEN regexp_full_match(core, '[0-9a-fA-F]+') THEN 1 WHEN regexp_full_match(core, '[a-z]+|[A-Z]+') THEN 2
              WHEN regexp_full_match(core, '[A-Z2-7]+') THEN 3 WHEN regexp_full_match(core, '[a-z0-9]+|[A-Z0-9]+') THEN 4 WHEN regexp_full_match(core, '[A-Za-z]+') THEN 5
              WHEN regexp_full_match(core, '[1-9A-HJ-NP-Za-km-z]+') THEN 6 WHEN regexp_full_match(core, '[A-Za-z0-9]+') THEN 7 ELSE 8 END AS code
  FROM cores WHERE length(core) >= 12),
lists AS (
  SELECT *, code >= 5 AS cased, string_split(core, '') AS c, string_split(low, '') AS l,
         list_transform(string_split(CASE WHEN code < 5 THEN low ELSE translate(core, '-_', '+/') END, ''),
                        lambda x: CAST(instr(CASE WHEN code < 5 THEN '0123456789abcdefghijklmnopqrstuvwxyz' ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END, x) AS DOUBLE)) AS p,
         CASE WHEN code >= 5 THEN core ELSE low END AS read FROM coded),
sums AS (
  SELECT *, list_sum(p) AS s, list_sum(list_transform(p, lambda x: x * x)) AS q, list_sum(list_transform(range(2, len(p) + 1), lambda j: p[j] * p[j - 1])) AS lagged,
         CAST(list_sum(list_transform(list_distinct(c), lambda x: pow(len(list_filter(c, lambda y: y = x)), 2))) AS DOUBLE) AS own,
         CAST(list_sum(list_transform(list_distinct(l), lambda x: pow(len(list_filter(l, lambda y: y = x)), 2))) AS DOUBLE) AS folded,
         n - length(regexp_replace(read, '[aeiou]', '', 'g')) AS c1, n - length(regexp_replace(read, '[tnshrdlcm]', '', 'g')) AS c2,
         n - length(regexp_replace(read, '[A-Z]', '', 'g')) AS c4, n - length(regexp_replace(read, '[0-9]', '', 'g')) AS c5 FROM lists),
fitted AS (SELECT *, code = 1 AND (16 * folded / n - n - 15) / sqrt(30e0) < (22 * own / n - n - 21) / sqrt(42e0) AS fold FROM sums),
stats AS (
  SELECT rid, start_, stop_, n, cased, [c1, c2, n - c1 - c2 - c4 - c5, c4, c5] AS cells,
         ([[2e0, 2, 2, 0, 10], [4e0, 4, 4, 0, 10], [5e0, 9, 12, 0, 0], [5e0, 9, 12, 0, 6], [5e0, 9, 12, 0, 10], [5e0, 9, 12, 26, 0], [5e0, 8, 12, 24, 9], [5e0, 9, 12, 26, 10], [5e0, 9, 14, 26, 10]])[CASE WHEN fold THEN 1 ELSE code + 1 END] AS alphabet,
         CAST(len(regexp_extract_all(core, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+')) - 1 AS DOUBLE) AS changes, CASE WHEN fold THEN folded ELSE own END AS squares,
         CASE WHEN q - n * (s / n) * (s / n) > 0 THEN (lagged - (s / n) * (2 * s - (p[1] + p[-1])) + (n - 1) * (s / n) * (s / n)) / (q - n * (s / n) * (s / n)) ELSE 1e0 END AS serial,
         regexp_matches(token, '^(?:[-_/+=]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}))+[-_/+=0-9]*$') AS written,
         regexp_matches(token, '[0-9]') AND regexp_matches(token, '^(?:[-_/+=]*(?:[A-Z]?[a-z]{3,}|[0-9]{1,4}))+[-_/+=]*$') AS numbered FROM fitted),
prior AS (SELECT * FROM (VALUES (FALSE, [36e-2, 44e-2, 18e-2, 0e0, 2e-2], 3e-2, 2e-3, 2e-1, 3e-2), (TRUE, [31e-2, 39e-2, 2e-1, 8e-2, 2e-2], 2e-1, 1e-2, 2e-1, 3e-2)) v(cased, shares, rate, between_, serial_, spread)),
totals AS (
  SELECT cased, CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(n - 1) AS m, sum(changes) AS x, sum(changes / (n - 1)) AS r, sum(pow(changes / (n - 1), 2)) AS rr, sum(1 / (n - 1)) AS i,
         sum(abs(serial)) AS z, sum(pow(abs(serial), 2)) AS zz, [sum(cells[1]), sum(cells[2]), sum(cells[3]), sum(cells[4]), sum(cells[5])] AS c FROM stats WHERE written GROUP BY cased),
filled AS (
  SELECT a.*, coalesce(k, 0e0) AS k, coalesce(n, 0e0) AS n, coalesce(m, 0e0) AS m, coalesce(x, 0e0) AS x, coalesce(r, 0e0) AS r, coalesce(rr, 0e0) AS rr, coalesce(i, 0e0) AS i, coalesce(z, 0e0) AS z,
         coalesce(zz, 0e0) AS zz, coalesce(c, [0e0, 0e0, 0e0, 0e0, 0e0]) AS c FROM prior a LEFT JOIN totals t ON a.cased = t.cased),
first_ AS (
  SELECT cased, k, list_transform(range(1, 6), lambda j: (4e2 * shares[j] + c[j]) / (4e2 + n)) AS shares, (4e2 * rate + x) / (4e2 + m) AS rate, (20 * serial_ + z) / (20 + k) AS serial_,
         between_ AS b0, spread AS s0, r, rr, i, z, zz FROM filled),
written_ AS (
  SELECT cased, shares, rate, (20 * b0 + greatest(0e0, rr - 2 * rate * r + k * rate * rate - rate * (1 - rate) * i)) / (20 + k) AS between_, serial_,
         (20 * s0 + zz - 2 * serial_ * z + k * serial_ * serial_) / (20 + k) AS spread FROM first_),
shared AS (SELECT s.*, list_sum(alphabet) AS size, w.shares, w.rate, w.between_, w.serial_, w.spread FROM stats s JOIN written_ w ON s.cased = w.cased),
chis AS (
  SELECT *, list_transform(alphabet, lambda a: a / size) AS e,
         list_sum(list_transform(range(1, 6), lambda j: CASE WHEN alphabet[j] > 0 THEN pow(cells[j] - n * (alphabet[j] / size), 2) / (n * (alphabet[j] / size)) ELSE 0e0 END)) AS chi FROM shared),
slopes AS (SELECT *, list_transform(range(1, 6), lambda j: CASE WHEN e[j] > 0 THEN (shares[j] - e[j]) / e[j] ELSE 0e0 END) AS a FROM chis),
means AS (
  SELECT *, n * list_sum(list_transform(range(1, 6), lambda j: CASE WHEN e[j] > 0 THEN pow(shares[j] - e[j], 2) / e[j] ELSE 0e0 END))
            + list_sum(list_transform(range(1, 6), lambda j: CASE WHEN e[j] > 0 THEN shares[j] * (1 - shares[j]) / e[j] ELSE 0e0 END)) AS mean_,
         4 * n * (list_sum(list_transform(range(1, 6), lambda j: shares[j] * a[j] * a[j])) - pow(list_sum(list_transform(range(1, 6), lambda j: shares[j] * a[j])), 2)) + 8 AS variance,
         1 - (pow(alphabet[1] + alphabet[2] + alphabet[3], 2) + pow(alphabet[4], 2) + pow(alphabet[5], 2)) / (size * size) AS drawn FROM slopes),
raw_ AS (
  SELECT *, (mean_ - chi) / sqrt(variance) AS z0, (mean_ - 4) / sqrt(variance) AS w0, (changes / (n - 1) - rate) / sqrt(between_ + rate * (1 - rate) / (n - 1)) AS z1,
         (drawn - rate) / sqrt(between_ + rate * (1 - rate) / (n - 1)) AS w1, (serial_ - abs(serial)) / sqrt(spread) AS z2, (serial_ - 8e-1 / sqrt(n)) / sqrt(spread) AS w2 FROM means),
moments AS (
  SELECT cased, (20 + sum(z0 * z0)) / (20 + count(*)) AS q0, (20 + sum(z1 * z1)) / (20 + count(*)) AS q1, (20 + sum(z2 * z2)) / (20 + count(*)) AS q2,
         sum(z0 * z1) / (20 + count(*)) AS p01, sum(z0 * z2) / (20 + count(*)) AS p02, sum(z1 * z2) / (20 + count(*)) AS p12 FROM raw_ WHERE written GROUP BY cased),
scaled AS (
  SELECT r.*, coalesce(q0, 1e0) AS q0, coalesce(q1, 1e0) AS q1, coalesce(q2, 1e0) AS q2, greatest(0e0, coalesce(p01 / sqrt(q0 * q1), 0e0)) AS p01,
         greatest(0e0, coalesce(p02 / sqrt(q0 * q2), 0e0)) AS p02, greatest(0e0, coalesce(p12 / sqrt(q1 * q2), 0e0)) AS p12 FROM raw_ r LEFT JOIN moments m ON r.cased = m.cased),
weighed AS (SELECT *, greatest(5e-2, w0 / sqrt(q0)) AS v0, greatest(5e-2, w1 / sqrt(q1)) AS v1, greatest(5e-2, w2 / sqrt(q2)) AS v2 FROM scaled),
zs AS (
  SELECT *, (v0 * (z0 / sqrt(q0)) + v1 * (z1 / sqrt(q1)) + v2 * (z2 / sqrt(q2))) / sqrt(v0 * v0 + v1 * v1 + v2 * v2 + 2 * v0 * v1 * p01 + 2 * v0 * v2 * p02 + 2 * v1 * v2 * p12) AS z,
         chi <= 185e-1 AND size * squares / n - n <= (size - 1) + 4 * sqrt(2 * (size - 1)) AS uniform,
         CASE WHEN n < 20 THEN 1e-1 WHEN n < 24 THEN 25e-2 WHEN n < 32 THEN 75e-2 ELSE 2e0 END AS weight FROM weighed),
bins AS (
  SELECT rid, start_, stop_, CASE WHEN uniform AND NOT numbered THEN greatest(0, CAST(floor(CASE WHEN z > 1 THEN least(3e3, -10 * (-(z * z / 2 + ln(z) + 0.9189385332046727e0) + ln(1 + (-1 / (z * z + 25e-1)))) / ln(10e0)) ELSE 0e0 END
           + 10 * log10(weight / avg(weight) OVER ())) AS INTEGER)) ELSE -1 END AS bin FROM zs),
counted AS (SELECT greatest(bin, 0) AS bin, count(*) AS k FROM bins GROUP BY 1),
ranked AS (SELECT bin, sum(k) OVER (ORDER BY bin DESC) AS found, sum(k) OVER () AS all_ FROM counted),
cut AS (SELECT coalesce(min(bin), 6000) AS cut FROM ranked WHERE bin > 0 AND pow(10e0, -bin / 10e0) <= 1e-2 * found / all_),
kept AS (
  SELECT rid, kind, start_, stop_ FROM spans WHERE kind < 3
  UNION ALL SELECT rid, 3, start_, stop_ FROM bins, cut WHERE bin >= cut),
named AS (SELECT rid, kind, start_, stop_, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start_ || ':' || stop_ AS w FROM kept),
joined AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(w, ',' ORDER BY start_, kind, stop_) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY start_, kind, stop_) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (rid)
""",
}
