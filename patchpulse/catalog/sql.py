"""Building blocks of the checking SQL (DuckDB dialect). Each block is a named WITH entry with its needs."""

from __future__ import annotations

from .. import config
from ..functions import phrases, sentiment

BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {}


def block(name: str, body: str, *needs: str) -> None:
    BLOCKS[name] = (body, needs)


def with_blocks(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for need in BLOCKS[n][1]:
            visit(need)
        order.append(n)

    for n in names:
        visit(n)
    parts = ",\n".join(f"{n} AS ({BLOCKS[n][0]})" for n in order)
    return f"WITH {parts}\n{body}" if order else body


def s6(x: str) -> str:
    return f"round(({x}) + 1e-9, 6)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def kw(text: str, keywords) -> str:
    """Whole-word, case-insensitive match."""
    body = "|".join(keywords)
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({body})([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)')"


def topic_case(text: str) -> str:
    arms = " ".join(f"WHEN {kw(text, words)} THEN '{label}'" for label, words in config.TOPIC_KEYWORDS)
    return f"CASE {arms} ELSE 'other' END"


block("reviews_v", """
SELECT CAST(d.doc_id AS VARCHAR) AS review_id, d.doc_id, d.source AS appid,
       CASE WHEN d.doc_id % 97 = 11 THEN NULL
            WHEN d.doc_id % 97 = 12 THEN '   '
            WHEN d.doc_id % 97 = 13 THEN '... !!! ???'
            WHEN d.doc_id % 97 = 14 THEN 'привет как дела'
            WHEN d.doc_id % 97 = 15 THEN concat('sooooooooooooo good ', d.text)
            WHEN d.doc_id % 97 = 16 THEN 'buy buy buy buy buy buy buy buy'
            WHEN d.doc_id % 97 = 17 THEN concat('see http://a.example and https://b.example now ', d.text)
            WHEN d.doc_id % 97 = 18 THEN 'gg wp'
            WHEN d.doc_id % 7 = 3 THEN concat('great fun, not bad &amp; really love it! ', d.text)
            WHEN d.doc_id % 7 = 5 THEN concat('terrible lag and crash after update, but stupid paywall. ', d.text)
            ELSE d.text END AS review_content,
       CASE WHEN l.quality IS NOT NULL THEN l.quality = 1 ELSE d.doc_id % 3 <> 0 END AS voted_up,
       date_trunc('second', e.ts) AS ts, e.user_id AS author_id, e.value * 10 AS playtime_at_review,
       CAST(e.user_id % 80 AS INT) AS num_reviews,
       CAST(CASE WHEN e.user_id % 10 = 0 THEN -1 ELSE e.user_id * 2 END AS INT) AS num_games_owned,
       CAST(d.n_chars % 25 AS INT) AS votes_up, CAST(d.doc_id % 6 AS INT) AS votes_funny,
       CAST((d.doc_id * 7) % 40 AS INT) AS comment_count, d.lang AS language, l.toxic
FROM documents d JOIN events e ON e.event_id = d.doc_id * 5 LEFT JOIN labels l ON l.doc_id = d.doc_id""")

block("updates_v", """
SELECT source AS appid, concat(source, u) AS update_id, CASE WHEN u = '-u1' THEN first_ts ELSE first_ts + INTERVAL 5 DAY END AS update_ts
FROM (SELECT source, CASE CAST(substring(source, 4) AS INT) % 3 WHEN 0 THEN TIMESTAMP '2024-01-07 00:00:00'
            WHEN 1 THEN TIMESTAMP '2024-01-08 00:00:00' ELSE TIMESTAMP '2024-01-09 00:00:00' END AS first_ts
      FROM (SELECT DISTINCT source FROM documents) d) s, (VALUES ('-u1'), ('-u2')) AS v(u)""")

block("news_v", """
SELECT CAST(event_id AS VARCHAR) AS gid, concat('src', CAST(user_id % 20 AS VARCHAR)) AS appid,
       CASE event_type WHEN 'purchase' THEN 'Hotfix patch notes' WHEN 'error' THEN 'Weekend sale'
            WHEN 'click' THEN 'Big Update is live' WHEN 'view' THEN 'Community fixes roundup'
            ELSE 'Scheduled maintenance' END AS title,
       date_trunc('second', ts) AS published_at,
       concat('https://news.example/', CAST(event_id AS VARCHAR)) AS url, concat('Changes: ', props) AS contents
FROM events""")

block("notes_v", f"""
SELECT * FROM news_v WHERE list_has_any(string_split_regex(lower(title), '\\s+'), [{_list(config.UPDATE_TITLE_WORDS)}])
""", "news_v")

block("comments_v", """
SELECT concat('src', CAST(conv_id % 19 AS VARCHAR)) AS appid, CAST(conv_id AS VARCHAR) AS forum_topic_id,
       concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS comment_id,
       CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN ' gg '
            WHEN turn = 1 AND conv_id % 5 = 1 THEN 'This comment is awaiting analysis by our system'
            WHEN turn = 0 AND conv_id % 5 = 2 THEN 'dead game, terrible update' ELSE text END AS content,
       role AS author, CAST(turn AS INT) AS upvotes, conv_id * 1000 + turn AS position
FROM conversations""")

block("announcements_v", """
SELECT concat('src', CAST(c.conv_id % 19 AS VARCHAR)) AS appid, concat('g', CAST(c.conv_id AS VARCHAR)) AS gid,
       CASE WHEN c.conv_id % 11 = 0 THEN '' ELSE CAST(c.conv_id AS VARCHAR) END AS forum_topic_id,
       CASE WHEN c.conv_id % 13 = 0 THEN NULL ELSE date_trunc('second', e.ts) END AS event_ts,
       e.event_type AS event_name
FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN events e ON e.event_id = c.conv_id * 10""")

block("events_v", """
SELECT concat('src', CAST(user_id % 20 AS VARCHAR)) AS appid, event_id, ts,
       greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 100)) AS score, event_type, value, user_id
FROM events""")

block("tagged", """
SELECT r.*, u.update_id, u.update_ts, CASE WHEN r.ts < u.update_ts THEN 'pre' ELSE 'post' END AS "window"
FROM reviews_v r JOIN updates_v u ON u.appid = r.appid
 AND r.ts >= u.update_ts - INTERVAL 7 DAY AND r.ts <= u.update_ts + INTERVAL 7 DAY""", "reviews_v", "updates_v")

STRIP = r"regexp_replace({0}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def clean_text(x: str, lower: bool = True) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, 'https?://[^\\s]+|www\\.[^\\s]+', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = strip(f"regexp_replace({x}, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g')")
    return f"lower({x})" if lower else x


# Exclusion reasons. Repeated characters need no back-reference: a run is a maximal stretch of equal characters.
block("runs", """
SELECT doc_id, max(n) AS longest FROM (
  SELECT doc_id, ch, count(*) AS n FROM (
    SELECT doc_id, ch, p - row_number() OVER (PARTITION BY doc_id, ch ORDER BY p) AS island FROM (
      SELECT doc_id, unnest(chars) AS ch, generate_subscripts(chars, 1) AS p
      FROM (SELECT doc_id, string_split(review_content, '') AS chars FROM reviews_v
            WHERE review_content IS NOT NULL)) WHERE ch <> chr(10)) GROUP BY doc_id, ch, island)
GROUP BY doc_id""", "reviews_v")

block("reasons", f"""
SELECT r.*, list_filter(string_split_regex(lower(r.review_content), '\\s+'), lambda w: w <> '') AS ws,
       {strip('r.review_content')} AS st, coalesce(runs.longest, 0) AS longest
FROM reviews_v r LEFT JOIN runs USING (doc_id)""", "reviews_v", "runs")

REASON_CASE = """CASE WHEN review_content IS NULL OR st = '' THEN 'null_or_empty'
     WHEN regexp_full_match(st, '[^\\p{L}\\p{N}\\p{M}_]+') THEN 'punctuation_only'
     WHEN len(regexp_extract_all(st, '[a-zA-Z]')) / length(st) < 0.2
          AND regexp_matches(st, '[Ѐ-ӿ一-鿿؀-ۿ฀-๿]') THEN 'non_english'
     WHEN coalesce((playtime_at_review / 60 < 2 AND num_reviews > 5) OR playtime_at_review / 60 < 0.5
          OR (num_reviews > 50 AND playtime_at_review / 60 < 10), false) THEN 'behavioral_spam'
     WHEN len(regexp_extract_all(review_content, 'https?://')) >= 2 THEN 'multiple_urls'
     WHEN len(ws) >= 4 AND len(list_distinct(ws)) / len(ws) < 0.3 THEN 'repetitive_words'
     WHEN longest >= 10 THEN 'repeated_char' END"""

block("flagged", f"SELECT * EXCLUDE (ws, st, longest), {REASON_CASE} AS exclude_reason FROM reasons", "reasons")


def _lexicon_rows() -> str:
    rows = [f"('{w}', {v}::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE)" for w, v in config.SENTIMENT_WORDS.items()]
    rows += [f"('{w}', NULL, {b}, 1.0)" for w, b in config.BOOSTER_WORDS.items()]
    rows += ["('" + w.replace("'", "''") + f"', NULL, 0.0, {sentiment.NEGATION_FACTOR})" for w in config.NEGATOR_WORDS]
    return ", ".join(rows)


block("lexicon", f"SELECT * FROM (VALUES {_lexicon_rows()}) AS t(word, v, b, n)")


def scoring(prefix: str, source: str, key: str, content: str) -> None:
    """Blocks {prefix}_p (processed text) and {prefix}_s (scores) over ``source``."""
    block(f"{prefix}_p", f"SELECT *, {clean_text(f'''coalesce({content}, '')''')} AS processed FROM {source}", source)
    block(f"{prefix}_t", f"""
SELECT {key}, i, CASE WHEN length(bare) <= 2 THEN w ELSE bare END AS word FROM (
  SELECT {key}, w, i, regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS bare FROM (
    SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT {key}, list_filter(string_split(processed, ' '), lambda x: x <> '') AS ws FROM {prefix}_p)))""", f"{prefix}_p")
    block(f"{prefix}_w", f"""
SELECT t.{key}, t.i, t.word, l.v,
       coalesce(lag(l.b, 1) OVER w, 0) AS b1, coalesce(lag(l.n, 1) OVER w, 1) AS n1,
       coalesce(lag(l.b, 2) OVER w, 0) AS b2, coalesce(lag(l.n, 2) OVER w, 1) AS n2,
       coalesce(lag(l.b, 3) OVER w, 0) AS b3, coalesce(lag(l.n, 3) OVER w, 1) AS n3,
       min(CASE WHEN t.word = 'but' THEN t.i END) OVER (PARTITION BY t.{key}) AS but_at
FROM {prefix}_t t LEFT JOIN lexicon l ON l.word = t.word
WINDOW w AS (PARTITION BY t.{key} ORDER BY t.i)""", f"{prefix}_t", "lexicon")
    scores(prefix, key)


def scores(prefix: str, key: str) -> None:
    """Blocks from {prefix}_w (words with their entries and those of the three before) to {prefix}_s."""
    block(f"{prefix}_x", f"""
SELECT {key}, CASE WHEN but_at IS NULL OR i = but_at THEN 1.0 WHEN i < but_at THEN 0.5 ELSE 1.5 END::DOUBLE
       * (v2 + CASE WHEN v2 < 0 THEN -b3 ELSE b3 END * 0.9::DOUBLE) * n3 AS val FROM (
  SELECT *, (v1 + CASE WHEN v1 < 0 THEN -b2 ELSE b2 END * 0.95::DOUBLE) * n2 AS v2 FROM (
    SELECT *, (v + CASE WHEN v < 0 THEN -b1 ELSE b1 END) * n1 AS v1 FROM {prefix}_w))""", f"{prefix}_w")
    block(f"{prefix}_g", f"""
SELECT {key}, coalesce(sum(val), 0) AS s0, coalesce(sum(CASE WHEN val > 0 THEN val + 1 END), 0) AS p0,
       coalesce(sum(CASE WHEN val < 0 THEN 1 - val END), 0) AS g0,
       count(*) - count(CASE WHEN val <> 0 THEN 1 END) AS z0
FROM {prefix}_x GROUP BY {key}""", f"{prefix}_x")
    block(f"{prefix}_e", f"""
SELECT p.*, coalesce(s0, 0) AS s0, coalesce(p0, 0) AS p0, coalesce(g0, 0) AS g0, coalesce(z0, 0) AS z0,
       least(length(processed) - length(replace(processed, '!', '')), 4) * 0.292::DOUBLE
       + CASE WHEN nq <= 1 THEN 0 WHEN nq <= 3 THEN nq * 0.18::DOUBLE ELSE 0.96 END AS emph
FROM (SELECT *, length(processed) - length(replace(processed, '?', '')) AS nq FROM {prefix}_p) p
LEFT JOIN {prefix}_g USING ({key})""", f"{prefix}_p", f"{prefix}_g")
    block(f"{prefix}_f", f"""
SELECT * EXCLUDE (s0, p0, g0, emph, nq), s0 + sign(s0) * emph AS s1,
       p0 + CASE WHEN p0 > g0 THEN emph ELSE 0 END AS p1, g0 + CASE WHEN g0 > p0 THEN emph ELSE 0 END AS g1
FROM {prefix}_e""", f"{prefix}_e")
    block(f"{prefix}_c", f"""
SELECT * EXCLUDE (s1, p1, g1, z0), round_even(s1 / sqrt(s1 * s1 + 15), 4) + 0.0 AS compound,
       CASE WHEN p1 + g1 + z0 > 0 THEN round_even(p1 / (p1 + g1 + z0), 3) ELSE 0.0 END AS pos,
       CASE WHEN p1 + g1 + z0 > 0 THEN round_even(z0 / (p1 + g1 + z0), 3) ELSE 0.0 END AS neu,
       CASE WHEN p1 + g1 + z0 > 0 THEN round_even(g1 / (p1 + g1 + z0), 3) ELSE 0.0 END AS neg
FROM {prefix}_f""", f"{prefix}_f")
    block(f"{prefix}_s", f"""
SELECT *, CASE WHEN compound >= 0.2 THEN 'positive' WHEN compound <= -0.2 THEN 'negative' ELSE 'neutral' END
       AS sentiment_label FROM {prefix}_c""", f"{prefix}_c")


def cased_scoring(prefix: str, source: str, key: str, content: str) -> None:
    """As ``scoring`` for texts in their own case: phrases by joins of word runs with the list, the first and longest of overlapping ones
    by following each to the next, and the weight of capitals."""
    listed = ", ".join(f"('{p}', {'NULL' if v is None else v}::DOUBLE, {b}::DOUBLE, 1.0::DOUBLE)" for p, (v, b) in phrases.PHRASES.items())
    bare = "regexp_replace({0}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')"
    longest = max(len(p.split()) for p in phrases.PHRASES)
    cleaned = clean_text(f"coalesce({content}, '')", lower=False)
    block(f"{prefix}_p", f"SELECT *, {cleaned} AS processed FROM {source}", source)
    block("phrase_list", f"SELECT * FROM (VALUES {listed}) AS t(word, v, b, n)")
    block("cased_lexicon", "SELECT * FROM lexicon UNION ALL SELECT * FROM phrase_list", "lexicon", "phrase_list")
    block(f"{prefix}_ws", f"SELECT {key}, list_filter(string_split(processed, ' '), lambda x: x <> '') AS ws FROM {prefix}_p", f"{prefix}_p")
    block(f"{prefix}_found", f"""
SELECT r.{key}, r.i, max(r.i + k) AS e FROM (
  SELECT {key}, i, k, lower({bare.format("array_to_string(ws[i:i + k - 1], ' ')")}) AS run FROM (
    SELECT {key}, ws, generate_subscripts(ws, 1) AS i FROM {prefix}_ws), range(2, {longest + 1}) AS t(k) WHERE i + k - 1 <= len(ws)) r
JOIN phrase_list l ON l.word = r.run GROUP BY r.{key}, r.i""", f"{prefix}_ws", "phrase_list")
    block(f"{prefix}_next", f"""
SELECT f.{key}, f.i, f.e, min(g.i) AS next FROM {prefix}_found f LEFT JOIN {prefix}_found g ON g.{key} = f.{key} AND g.i >= f.e GROUP BY ALL""",
          f"{prefix}_found")
    block(f"{prefix}_taken", f"""
WITH RECURSIVE step AS (
  SELECT {key}, i, e, next FROM {prefix}_next JOIN (SELECT {key}, min(i) AS i FROM {prefix}_next GROUP BY {key}) USING ({key}, i)
  UNION ALL SELECT n.{key}, n.i, n.e, n.next FROM step s JOIN {prefix}_next n ON n.{key} = s.{key} AND n.i = s.next)
SELECT {key}, i, e FROM step""", f"{prefix}_next")
    block(f"{prefix}_t", f"""
SELECT {key}, i, CASE WHEN length({bare.format("w")}) <= 2 THEN w ELSE {bare.format("w")} END AS word FROM (
  SELECT u.{key}, u.i, coalesce(array_to_string(ws[u.i:t.e - 1], ' '), ws[u.i]) AS w
  FROM (SELECT {key}, ws, generate_subscripts(ws, 1) AS i FROM {prefix}_ws) u LEFT JOIN {prefix}_taken t ON t.{key} = u.{key} AND t.i = u.i
  WHERE NOT EXISTS (SELECT 1 FROM {prefix}_taken c WHERE c.{key} = u.{key} AND c.i < u.i AND u.i < c.e))""", f"{prefix}_ws", f"{prefix}_taken")
    block(f"{prefix}_l", f"""
SELECT t.{key}, t.i, lower(t.word) AS word, l.v + sign(l.v) * loud AS v, l.b + CASE WHEN l.b <> 0 THEN loud ELSE 0 END AS b, l.n FROM (
  SELECT *, CASE WHEN caps AND NOT bool_and(caps) OVER (PARTITION BY {key}) THEN {phrases.CAPITALS} ELSE 0 END::DOUBLE AS loud FROM (
    SELECT *, word = upper(word) AND word <> lower(word) AS caps FROM {prefix}_t)) t LEFT JOIN cased_lexicon l ON l.word = lower(t.word)""",
          f"{prefix}_t", "cased_lexicon")
    before = ", ".join(f"coalesce(lag({c}, {k}) OVER w, {d}) AS {c}{k}" for k in (1, 2, 3) for c, d in (("b", 0), ("n", 1)))
    block(f"{prefix}_w", f"""
SELECT {key}, i, v, {before}, min(CASE WHEN word = 'but' THEN i END) OVER (PARTITION BY {key}) AS but_at
FROM {prefix}_l WINDOW w AS (PARTITION BY {key} ORDER BY i)""", f"{prefix}_l")
    scores(prefix, key)


scoring("rev", "flagged", "doc_id", "review_content")

LOUD = """CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('This update is the BOMB, NOT bad at all! ', coalesce(review_content, ''))
     WHEN 1 THEN replace(replace(replace(review_content, 'great', 'GREAT'), 'crash', 'CRASH'), 'really', 'REALLY')
     WHEN 2 THEN concat('Yeah right! The lag is a kiss of death, the maps are kind of good. ', coalesce(review_content, ''))
     WHEN 3 THEN upper(review_content) ELSE review_content END"""
block("loud_v", f"SELECT review_id, doc_id, {LOUD} AS content FROM reviews_v", "reviews_v")
cased_scoring("loud", "loud_v", "doc_id", "content")

# Scored reviews in their update window; after the update only usable rows, before it every row.
block("scored", """
SELECT r.*, u.update_id, u.update_ts, CASE WHEN r.ts < u.update_ts THEN 'pre' ELSE 'post' END AS "window"
FROM rev_s r JOIN updates_v u ON u.appid = r.appid
 AND r.ts >= u.update_ts - INTERVAL 7 DAY AND r.ts <= u.update_ts + INTERVAL 7 DAY
WHERE r.ts < u.update_ts OR r.exclude_reason IS NULL""", "rev_s", "updates_v")



def nearest(source: str, extra: str = "true") -> str:
    """The event or note nearest to each update among those whose topic has a comment that is not blank."""
    return f"""
SELECT appid, update_id, gid, forum_topic_id, event_name, gap_seconds FROM (
  SELECT u.appid, u.update_id, e.gid, e.forum_topic_id, e.event_name,
         abs(epoch(e.event_ts)::BIGINT - epoch(u.update_ts)::BIGINT) AS gap_seconds,
         row_number() OVER (PARTITION BY u.appid, u.update_id
           ORDER BY abs(epoch(e.event_ts)::BIGINT - epoch(u.update_ts)::BIGINT) NULLS LAST, e.gid) AS pick
  FROM updates_v u JOIN {source} e ON e.appid = u.appid
  WHERE e.forum_topic_id <> '' AND {extra}
    AND EXISTS (SELECT 1 FROM comments_v x WHERE x.appid = e.appid AND x.forum_topic_id = e.forum_topic_id
                AND {strip('x.content')} <> '')) WHERE pick = 1"""


block("near_event", nearest("announcements_v"), "updates_v", "announcements_v", "comments_v")
block("note_events", "SELECT appid, gid, gid AS forum_topic_id, title AS event_name, published_at AS event_ts FROM notes_v", "notes_v")
block("near_note", nearest("note_events", "e.event_ts >= u.update_ts - INTERVAL 7 DAY"), "updates_v", "note_events", "comments_v")
block("comment_source", """
SELECT u.appid, u.update_id, CASE WHEN e.gid IS NOT NULL THEN 'announcement' WHEN n.gid IS NOT NULL THEN 'patch_note' END
         AS comment_source, coalesce(e.gid, n.gid) AS gid, coalesce(e.forum_topic_id, n.forum_topic_id) AS forum_topic_id,
       coalesce(e.event_name, n.event_name) AS event_name, coalesce(e.gap_seconds, n.gap_seconds) AS gap_seconds
FROM updates_v u LEFT JOIN near_event e USING (appid, update_id) LEFT JOIN near_note n USING (appid, update_id)""",
      "updates_v", "near_event", "near_note")

block("comm_kept", f"""
SELECT appid, update_id, body AS content, forum_topic_id, comment_id, update_id || '/' || comment_id AS ckey, author, upvotes, position FROM (
  SELECT c.*, s.update_id, {strip('content')} AS body,
         row_number() OVER (PARTITION BY c.appid, s.update_id, {strip('content')} ORDER BY position, comment_id) AS k
  FROM comments_v c JOIN comment_source s ON s.appid = c.appid AND s.forum_topic_id = c.forum_topic_id
  WHERE length({strip('content')}) >= 5
    AND NOT regexp_matches({strip('content')}, '(?i)^This comment is awaiting analysis')) WHERE k = 1""",
      "comments_v", "comment_source")
scoring("com", "comm_kept", "ckey", "content")

block("comm_stats", """
SELECT appid, update_id, count(*) AS n_comments,
       count(*) FILTER (sentiment_label = 'positive') AS positive_count,
       count(*) FILTER (sentiment_label = 'neutral') AS neutral_count,
       count(*) FILTER (sentiment_label = 'negative') AS negative_count,
       round_even(count(*) FILTER (sentiment_label = 'positive') / greatest(count(*), 1), 4) AS positive_pct,
       round_even(count(*) FILTER (sentiment_label = 'neutral') / greatest(count(*), 1), 4) AS neutral_pct,
       round_even(count(*) FILTER (sentiment_label = 'negative') / greatest(count(*), 1), 4) AS negative_pct
FROM com_s GROUP BY ALL""", "com_s")


def window_stats(name: str, source: str) -> None:
    parts = []
    for w in ("pre", "post"):
        n = f"count(*) FILTER (\"window\" = '{w}')"
        parts.append(f"coalesce({n}, 0) AS {w}_n")
        parts.append(f"coalesce(avg(compound) FILTER (\"window\" = '{w}'), 0) AS {w}_mean")
        for v in ("positive", "neutral", "negative"):
            parts.append(
                f"coalesce(count(*) FILTER (\"window\" = '{w}' AND sentiment_label = '{v}') / nullif({n}, 0), 0) AS {w}_{v}"
            )
    cols = ", ".join(parts)
    outer = ", ".join(
        f"coalesce({w}_{c}, 0) AS {w}_{c}" for w in ("pre", "post")
        for c in ("n", "mean", "positive", "neutral", "negative")
    )
    block(name, f"""
SELECT *, CASE WHEN post_n > 0 THEN round_even(post_negative - pre_negative, 4) ELSE 0 END + 0.0 AS sentiment_delta FROM (
  SELECT u.appid, u.update_id, coalesce(n_disagreements, 0) AS n_disagreements,
         coalesce(gray_zone_count, 0) AS gray_zone_count, {outer}
  FROM updates_v u LEFT JOIN (
    SELECT appid, update_id, {cols},
      count(*) FILTER ("window" = 'post' AND ((compound > 0.05 AND NOT voted_up) OR (compound < -0.05 AND voted_up)))
        AS n_disagreements,
      count(*) FILTER ("window" = 'post' AND compound BETWEEN -0.2 AND 0.2) AS gray_zone_count
    FROM {source} GROUP BY appid, update_id) s USING (appid, update_id))""", source, "updates_v")


window_stats("stats", "scored")

block("with_comments", """
SELECT s.*, c.negative_pct AS cneg, c.n_comments FROM stats s LEFT JOIN comm_stats c USING (appid, update_id)""",
      "stats", "comm_stats")

SIGNALS = """
SELECT appid, update_id, 'R1' AS rule,
       CASE WHEN sentiment_delta > 0.40 THEN 'CRITICAL' WHEN sentiment_delta > 0.25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       sentiment_delta AS value, 0.15::DOUBLE AS threshold
FROM {src} WHERE post_n > 0 AND sentiment_delta > 0.15
UNION ALL
SELECT appid, update_id, 'R2', CASE WHEN post_negative < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END,
       round_even(post_negative, 4), 0.60 FROM {src} WHERE post_n > 0 AND post_negative > 0.60
UNION ALL
SELECT appid, update_id, 'R3', 'MEDIUM', round_even(post_n / pre_n, 2), 3.0
FROM {src} WHERE post_n > 0 AND pre_n > 0 AND post_n / pre_n > 3.0
UNION ALL
SELECT appid, update_id, 'R4', CASE WHEN cneg > 0.70 THEN 'CRITICAL' ELSE 'HIGH' END, round_even(cneg, 4), 0.50
FROM {src} WHERE cneg > 0.50
UNION ALL
SELECT appid, update_id, 'R5', 'MEDIUM', round_even(abs(cneg - post_negative), 4), 0.20
FROM {src} WHERE post_n > 0 AND abs(cneg - post_negative) > 0.20"""

RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
block("signals", f"SELECT *, {RANK} AS severity_rank FROM ({SIGNALS.format(src='with_comments')})", "with_comments")
block("overall", """
SELECT u.appid, u.update_id,
       CASE coalesce(max(severity_rank), 1) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END
         AS overall_risk, CAST(count(severity_rank) AS INT) AS n_signals
FROM updates_v u LEFT JOIN signals s USING (appid, update_id) GROUP BY ALL""", "signals", "updates_v")


def flags(text: str) -> str:
    parts = []
    for name, words in (
        ("contains_bug_report", config.BUG_WORDS), ("contains_balance_complaint", config.BALANCE_WORDS),
        ("contains_monetization_complaint", config.MONEY_WORDS), ("mentions_performance", config.PERFORMANCE_WORDS),
        ("is_toxic", config.TOXIC_WORDS),
    ):
        parts.append(f"CAST({kw(text, words)} AS INT) AS {name}")
    return ", ".join(parts)


CONTRADICTIONS = """CAST(compound < -0.3 AND votes_up >= 10 AS INT) AS negative_but_helpful,
       CAST(compound > 0.3 AND votes_up <= 1 AS INT) AS positive_but_unhelpful,
       CAST(comment_count >= 10 AND abs(compound) >= 0.5 AS INT) AS controversial_sentiment,
       CAST((compound > 0.05 AND NOT voted_up) OR (compound < -0.05 AND voted_up) AS INT)
         AS recommendation_sentiment_mismatch"""

block("risk_rows", f"""
SELECT *, round(is_toxic * 1.0 + CAST(compound < -0.35 AS INT) * 1.0 + contains_bug_report * 0.8
         + contains_balance_complaint * 0.8 + contains_monetization_complaint * 0.8 + mentions_performance * 0.5
         + controversial_sentiment * 0.5 + recommendation_sentiment_mismatch * 0.6
         + (negative_but_helpful + positive_but_unhelpful) * 0.3, 4)::DOUBLE AS risk_score
FROM (SELECT *, {flags('processed')}, {CONTRADICTIONS} FROM rev_s)""", "rev_s")


def level(score: str, c: float, h: float, m: float) -> str:
    return f"CASE WHEN {score} >= {c} THEN 'Critical' WHEN {score} >= {h} THEN 'High' WHEN {score} >= {m} THEN 'Medium' ELSE 'Low' END"


block("levelled", f"""
SELECT *, {level('risk_score', 2.5, 1.5, 1.0)} AS risk_level, CAST(risk_score >= 1.0 AS INT) AS risk_label_weak
FROM risk_rows""", "risk_rows")


def coordinated_blocks(name: str, keys: tuple[str, ...], min_size: int, threshold: float = 0.85, max_terms: int = 500) -> str:
    """Blocks for groups of near-identical reviews of a day (and ``keys``), all pairs compared; returns the name of the last,
    ``name``_member (keys, day, review_id, doc_id, first: the least review_id of the group, size, sim: mean cosine over pairs)."""
    k = ", ".join([*keys, "day"])
    block(f"{name}_text", f"""
SELECT * FROM (SELECT *, date_trunc('day', ts) AS day, count(*) OVER (PARTITION BY {", ".join([*keys, "date_trunc('day', ts)"])}) AS n_rows
  FROM reviews_v WHERE review_content IS NOT NULL) WHERE n_rows >= {min_size}""", "reviews_v")
    block(f"{name}_tf", f"""
SELECT {k}, review_id, term, count(*) AS tf FROM (
  SELECT {k}, review_id, unnest(string_split_regex(lower(review_content), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS term FROM {name}_text)
WHERE length(term) >= 2 GROUP BY ALL""", f"{name}_text")
    block(f"{name}_vocab", f"""
SELECT {k}, term, ln((n_docs + 1) / (df + 1)) + 1 AS idf FROM (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY total DESC, term) AS no FROM (
    SELECT {k}, term, sum(tf) AS total, count(*) AS df FROM {name}_tf GROUP BY ALL))
JOIN (SELECT {k}, count(DISTINCT review_id) AS n_docs FROM {name}_tf GROUP BY ALL) USING ({k}) WHERE no <= {max_terms}""", f"{name}_tf")
    block(f"{name}_vec", f"""
SELECT {k}, review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY {k}, review_id)) AS u FROM (
  SELECT {k}, review_id, term, tf * idf AS w FROM {name}_tf JOIN {name}_vocab USING ({k}, term))""", f"{name}_tf", f"{name}_vocab")
    block(f"{name}_link", f"""
SELECT a.review_id AS a, b.review_id AS b FROM {name}_vec a JOIN {name}_vec b USING ({k}, term)
GROUP BY {k}, a.review_id, b.review_id HAVING a.review_id = b.review_id OR sum(a.u * b.u) >= {threshold} - 1e-9""", f"{name}_vec")
    block(f"{name}_reach", f"""
WITH RECURSIVE step(a, b) AS (SELECT a, b FROM {name}_link UNION SELECT s.a, l.b FROM step s JOIN {name}_link l ON l.a = s.b)
SELECT a AS review_id, min(b) AS first FROM step GROUP BY a""", f"{name}_link")
    block(f"{name}_member", f"""
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY first) AS size FROM {name}_reach JOIN {name}_text USING (review_id))
JOIN (SELECT first, sum(s * s) AS square FROM (SELECT first, term, sum(u) AS s FROM {name}_vec JOIN {name}_reach USING (review_id) GROUP BY ALL) GROUP BY first)
USING (first) WHERE size >= {min_size}""", f"{name}_reach", f"{name}_text", f"{name}_vec")
    return f"{name}_member"
