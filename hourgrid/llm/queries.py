"""The registered queries of the text operators and their checking SQL."""

from pyspark.sql import functions as F

import corpus_pipeline
from hourgrid.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    fingerprints,
    lexical_search,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    pii,
    sharding,
    token_counts,
    toxicity,
)
from hourgrid.llm.settings import (
    END_ID,
    HAMMING_RADIUS,
    LINE_DOCUMENTS,
    RANKED,
    SEQUENCE,
    SHARDS,
    SHINGLE_WORDS,
    SURROGATE_KEY,
    TOKEN_LIMIT,
    TOKENIZER,
    TOXIC,
)
from hourgrid.session import Scratch, cut_lineage

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLE = {}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(name, sql=None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql.strip()
        return build

    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_token_counts")
def op7(spark, folder):
    counts = token_counts.token_counts(table(spark, folder, "documents"), TOKENIZER)
    return token_counts.over_limit(counts, TOKEN_LIMIT)


@query("op5_packing")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    with Scratch(spark, "packing") as scratch:
        pieces = packing.pack(scratch, docs, TOKENIZER, END_ID, SEQUENCE)
        return cut_lineage(packing.digests(pieces), "packing")


@query(
    "op8_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM (SELECT doc_id, sha256(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents)
    WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op8(spark, folder):
    with Scratch(spark, "exact") as scratch:
        groups = exact_dedup.exact_groups(
            scratch, table(spark, folder, "documents"), all_digests=True
        )
        sha = F.lower(F.hex("digest")).alias("text_sha256")
        return cut_lineage(
            groups.select("doc_id", "keep_id", "group_size", "kept", sha), "exact"
        )


@query("op9_sharding")
def op9(spark, folder):
    with Scratch(spark, "shards") as scratch:
        placed = sharding.shard_by_bytes(scratch, table(spark, folder, "documents"), SHARDS)
        return cut_lineage(
            placed.select(
                "doc_id",
                "size",
                "text_crc32",
                F.lit("bytes").alias("law"),
                "shard",
                "slot",
                F.lit(None).cast("int").alias("grown_shard"),
            ),
            "shards",
        )


@query(
    "op2_line_dedup",
    r"""
    WITH lines AS (
      SELECT r, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
      FROM (SELECT row_number() OVER () AS r, doc_id,
                   string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines),
    heavy AS (
      SELECT key, true AS gone FROM keyed WHERE key <> ''
      GROUP BY key HAVING count(DISTINCT r) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), ''))
             AS kept_sha256
    FROM keyed LEFT JOIN heavy USING (key) GROUP BY r, doc_id
    """,
)
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    with Scratch(spark, "lines") as scratch:
        index = line_dedup.LineIndex(spark, scratch.folder("index"), LINE_DOCUMENTS)
        index.insert(docs)
        kept = index.drop_lines(docs).withColumnRenamed("sha256", "kept_sha256")
        return cut_lineage(kept.drop("text"), "lines")


@query("op10_near_dedup")
def op10(spark, folder):
    with Scratch(spark, "near") as scratch:
        rows = near_dedup.near_components(
            scratch, table(spark, folder, "documents"), SHINGLE_WORDS
        )
        return cut_lineage(rows, "near")


@query("op4_toxicity")
def op4(spark, folder):
    docs, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    with Scratch(spark, "toxicity") as scratch:
        model = toxicity.learn(scratch, docs, labels)
    return model.score(docs.select("doc_id", "text")).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"),
    )


@query("op6_decontamination")
def op6(spark, folder):
    docs, benchmark = (table(spark, folder, name) for name in ("documents", "benchmark"))
    leaks = decontaminate.with_leaks(docs.select("doc_id", "text"), benchmark)
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op1_license_scan", license_scan.checking_sql())
def op1(spark, folder):
    return license_scan.scan(table(spark, folder, "documents"))


@query("op3_pii")
def op3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    with Scratch(spark, "pii") as scratch:
        kept = scratch.stage(pii.settled(scratch, docs, SURROGATE_KEY), "settled")
        rows = pii.rewritten(docs, SURROGATE_KEY, kept)
        return rows.select("doc_id", "n_entities", "text")


@query("op11_fingerprints")
def op11(spark, folder):
    docs = table(spark, folder, "documents")
    with Scratch(spark, "prints") as scratch:
        rows = scratch.stage(fingerprints.trial(scratch, docs), "rows")
        classes = fingerprints.near_classes(scratch, rows, HAMMING_RADIUS)
        found = rows.join(classes, "fingerprint").select(
            "doc_id",
            "n_chars",
            *[
                F.lower(F.hex(name)).alias(name)
                for name in ("edited_sha256", "fingerprint", "edited_fingerprint")
            ],
            "near_edited",
            "near_next",
            "class_id",
            "class_size",
            "n_near",
        )
        return cut_lineage(found, "prints")


def repair_sql():
    """Best suffix of every state, from the last row back, as text: cost, then initials."""

    def edit(suffix, cost, initial):
        return f"printf('%06d', left({suffix}, 6)::INT + {cost}) || '{initial}' || substr({suffix}, 7)"

    after = {0: 2, 1: 2, 2: 3, 3: 2}
    gone = "fault IN ('blank', 'duplicate')"
    extra = "(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)"
    plain, best = [], []
    for state, follow in after.items():
        kept = {0: "role[1] IN ('s', 'u')", 2: "role[1] = 'a'"}.get(state, "role[1] = 'u'")
        to = "CASE role[1] WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE v3 END"
        plain.append(
            f"least({edit(f'v{state}', 3, 'D')}, "
            f"CASE WHEN NOT {gone} THEN {edit(f'v{follow}', f'2 + {extra}', 'R')} END, "
            f"CASE WHEN NOT {gone} AND {kept} THEN {edit(f'({to})', extra, 'K')} END) AS e{state}"
        )
        twice = edit(f"e{after[follow]}", 4, "II")
        best.append(f"least(e{state}, {edit(f'e{follow}', 2, 'I')}, {twice})")
    return f"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
      FROM conversations),
    kinds AS (
      SELECT *, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT,
                       list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                            lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
      FROM keyed),
    hurt AS (
      SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                       ELSE text END AS text,
             unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM kinds WHERE kind <> 0),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id
                                   ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
      FROM hurt),
    faulty AS (
      SELECT conv_id, i, turn, role, text,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1
                    THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated'
                  ELSE 'none' END AS fault
      FROM placed),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
      FROM faulty GROUP BY conv_id),
    suffixes AS (
      SELECT conv_id, n + 1 AS i, '000000' AS v0, '000004II' AS v1, '000002I' AS v2,
             '000000' AS v3
      FROM counts
      UNION ALL
      SELECT conv_id, i, {", ".join(best)}
      FROM (SELECT f.conv_id, f.i, {", ".join(plain)}
            FROM suffixes s JOIN faulty f
              ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1)),
    audits AS (SELECT conv_id, left(v0, 6)::BIGINT AS cost, substr(v0, 7) AS audit
               FROM suffixes WHERE i = 1),
    letters AS (
      SELECT conv_id, unnest(string_split(audit, '')) AS letter,
             generate_subscripts(string_split(audit, ''), 1) AS p
      FROM audits WHERE audit <> ''),
    aligned AS (
      SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i
      FROM letters),
    written AS (
      SELECT a.conv_id, a.p, a.letter, f.role, CASE a.letter WHEN 'I' THEN '' ELSE f.text END AS text,
             row_number() OVER (PARTITION BY a.conv_id ORDER BY a.p) - 1
               - max(CASE WHEN a.letter = 'K' AND f.role[1] = 's' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY a.conv_id) AS k
      FROM aligned a LEFT JOIN faulty f
        ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i
      WHERE a.letter <> 'D'),
    hashes AS (
      SELECT conv_id, sha256(string_agg(
               CASE WHEN letter = 'K' THEN role WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END
               || ':' || text, chr(10) ORDER BY p)) AS sha
      FROM written GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
           coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
           coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
    """


@query("op12_conversation_repair", repair_sql())
def op12(spark, folder):
    rows = table(spark, folder, "conversations")
    with Scratch(spark, "repair") as scratch:
        return cut_lineage(conversation_repair.trial(scratch, rows), "repair")


@query(
    "op13_lexical_search",
    r"""
    WITH texts AS (
      SELECT doc_id, regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents WHERE text IS NOT NULL),
    sizes AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
    tfs AS (
      SELECT doc_id, term, count(*) AS tf
      FROM (SELECT doc_id, unnest(terms) AS term FROM texts) GROUP BY ALL),
    weights AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE)
                                        / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tfs CROSS JOIN total GROUP BY term),
    wanted AS (
      SELECT item_id, term, count(*) AS repeats
      FROM (SELECT item_id, unnest(regexp_extract_all(
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark) GROUP BY ALL),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf)
               // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words))))) AS BIGINT) AS score
      FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id)
           CROSS JOIN total
      GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
          FROM scored WHERE score > 0)
    WHERE rank <= 20
    """,
)
def op13(spark, folder):
    docs, items = (table(spark, folder, name) for name in ("documents", "benchmark"))
    with Scratch(spark, "search") as scratch:
        return cut_lineage(lexical_search.ranked(scratch, docs, items, RANKED), "search")
