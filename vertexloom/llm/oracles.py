"""SQL for DuckDB that gives the rows of the corpus queries, where SQL can express them.

Each states the contract anew, by plain joins and windows over whole tables, and shares no code with its operator, only a table of fixed values.
``op2`` (a fitted model) and ``op9`` (votes over parsed markup) have none.
"""

from .telephony import STEPS

#: Words are told apart after this lowers A to Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either(*patterns: str) -> str:
    """Alternatives whose letters come in either case; a flag would fold letters beyond ASCII too."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p) for p in patterns)


def _spans(kind: str, order: int, pattern: str, check: str = "true", group: int = 0) -> str:
    """Leftmost non-overlapping matches in d (rid, text): rid, kind, ord, lo, hi. check may use m, the match, and g, a group of it.

    A match starts after the pieces and matches before it.
    """
    found = "regexp_extract_all(text, '" + pattern.replace("'", "''") + "'"
    split = "string_split_regex(text, '" + pattern.replace("'", "''") + "')"
    return f"""
  SELECT rid, '{kind}' AS kind, {order} AS ord, lo, lo + length(m) AS hi FROM (
    SELECT rid, m, g, sum(length(piece) + length(m)) OVER (PARTITION BY rid ORDER BY k)::BIGINT - length(m) AS lo FROM (
      SELECT rid, unnest({found})) AS m, unnest({found}, {group})) AS g, unnest({split}[:len({found}))]) AS piece,
             generate_subscripts({found}), 1) AS k FROM d))
  WHERE {check}"""


_D = "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"
_LISTED = "string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, ord, hi)"

_TAIL = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = "(" + _either("password", "passwd", "secret", "token", "api_?key") + ")" + _TAIL + "([A-Za-z0-9+/_.=-]+)"
_LINK_ID = "(" + _either("client_?id", "account_?id", "access_?key_?id", "user_?name", "login") + ")" + _TAIL + "([A-Za-z0-9@._-]+)"
_ENDPOINT = "(?:" + _either("https?", "ftp", "s3", "postgres(ql)?", "mysql", "mongodb", "redis", "amqps?") + r""")://[^\x20\x09-\x0D"'<>]+"""
_MIXED = "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"

OP3_SQL = rf"""
WITH {_D},
strong AS ({_spans("assign", 0, _ASSIGN, "length(g) >= 12", 2)}
  UNION ALL{_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18")}
  UNION ALL{_spans("hex", 2, "[0-9a-f]+", "length(m) >= 16")}),
weak AS ({_spans("link_id", 3, _LINK_ID, "length(g) >= 3", 2)}
  UNION ALL{_spans("link_secret", 4, "[A-Za-z0-9+/=_-]+", _MIXED)}
  UNION ALL{_spans("link_endpoint", 5, _ENDPOINT, "length(m) >= 8")}),
free AS (SELECT * FROM weak w WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.rid = w.rid AND s.lo < w.hi AND s.hi > w.lo)),
parts AS (SELECT rid, lo, hi, CASE kind WHEN 'access' THEN 'id' WHEN 'link_id' THEN 'id' WHEN 'link_endpoint' THEN 'endpoint' WHEN 'link_secret' THEN 'token' ELSE 'secret' END AS role
  FROM (SELECT * FROM strong UNION ALL SELECT * FROM free)),
linked AS (
  SELECT * FROM free w WHERE EXISTS (SELECT 1 FROM parts s WHERE s.rid = w.rid AND s.lo <= w.hi + 256 AND s.hi >= w.lo - 256
    AND (s.lo >= w.hi OR s.hi <= w.lo)
    AND CASE w.kind WHEN 'link_id' THEN s.role IN ('secret', 'token') WHEN 'link_secret' THEN s.role = 'id' ELSE s.role IN ('id', 'secret') END)),
base AS (SELECT rid, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
                {_LISTED} AS spans FROM strong GROUP BY rid),
every AS (SELECT rid, {_LISTED} AS spans FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(""" + _LOWER + r""", '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT rid, doc_id, CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda pos: w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2])) END AS grams
  FROM d),
rows_ AS (SELECT rid, doc_id, len(grams)::BIGINT AS n, CASE WHEN len(grams) > 0 THEN sha256(array_to_string(list_sort(grams), chr(10))) END AS class, grams FROM g),
classes AS (SELECT class, any_value(n) AS n, min(doc_id) AS least_id, any_value(grams) AS grams FROM rows_ WHERE class IS NOT NULL GROUP BY class),
flat AS (SELECT class, n, unnest(grams) AS gram FROM classes),
links AS (
  SELECT a.class AS a, b.class AS b FROM flat a JOIN flat b ON a.gram = b.gram AND a.class <> b.class AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT class AS a, class AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(least_id) AS component_id FROM reach JOIN classes ON class = b GROUP BY a)
SELECT doc_id, n AS n_shingles, CASE WHEN class IS NULL THEN doc_id ELSE component_id END AS component_id
FROM rows_ LEFT JOIN roots ON class = a
"""

_CRC = """rule AS (
  SELECT b AS byte, b::BIGINT AS crc, 0 AS bit FROM range(256) t(b)
  UNION ALL
  SELECT byte, xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END), bit + 1 FROM rule WHERE bit < 8),
crcs AS (SELECT list(crc ORDER BY byte) AS table_ FROM rule WHERE bit = 8)"""


def _crc32(of_bytes: str) -> str:
    """CRC-32 of a list of byte values."""
    return f"xor(list_reduce({of_bytes}, lambda a, b: xor(a >> 8, table_[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def _bytes(of_hex: str) -> str:
    return f"list_transform(regexp_extract_all({of_hex}, '..'), lambda x: ('0x' || x)::BIGINT)"


def _hex32(number: str) -> str:
    """Four bytes, the lowest first."""
    return "||".join(f"printf('%02X', ({number} >> {k}) & 255)" for k in (0, 8, 16, 24))


OP5_SQL = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
k AS (
  SELECT doc_id, (length(bytes) // 2 + 1)::BIGINT AS size, coalesce(doc_id::VARCHAR, 'text ' || text) AS key,
         ('0x' || substr(md5('slot:' || coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 15))::BIGINT AS h,
         {_crc32(_bytes("bytes"))} AS text_crc32
  FROM d, crcs),
scores AS (SELECT *, list_transform(range(9), lambda i: ln((('0x' || substr(md5(key || '#' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496)) AS s FROM k),
dealt AS (SELECT *, (list_position(s[:8], list_max(s[:8])) - 1)::INT AS shard, (list_position(s, list_max(s)) - 1)::INT AS grown_shard FROM scores)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM dealt
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[pos:pos + k - 1], ' ') AS span FROM p),
lengths AS (SELECT DISTINCT k FROM windows),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
runs AS (
  SELECT rid, pos, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM words),
spans AS (SELECT rid, pos, k, array_to_string(run[1:k], ' ') AS span FROM runs, lengths WHERE len(run) >= k),
found AS (SELECT rid, pos, k, item FROM spans JOIN windows USING (k, span)),
hit AS (SELECT rid, count(DISTINCT word_at)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(pos, pos + k)) AS word_at FROM (SELECT DISTINCT rid, pos, k FROM found)) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: reverse({_DIGITS})[k]::INT * (2 - k % 2) - CASE WHEN k % 2 = 0 AND reverse({_DIGITS})[k]::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0"
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_URL = r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[^<>\x22\x27" + _SPACE + "]+"

OP7_SQL = rf"""
WITH RECURSIVE {_D},
base AS ({_spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")}
  UNION ALL{_spans("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast(right(p, 3) AS INT) > 255)) = 0")}
  UNION ALL{_spans("card", 2, r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}
  UNION ALL{_spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")}),
urls AS (
  SELECT rid, 'url' AS kind, 4 AS ord, lo, lo + length(whole) AS hi
  FROM (SELECT rid, lo, regexp_replace(substr(text, lo + 1, hi - lo), '[.,;:!?)\]}}]+$', '') AS whole FROM ({_spans("url", 4, _URL)}) JOIN d USING (rid))
  WHERE length(whole) > strpos(whole, '://') + 2),
cues AS (
  SELECT rid, lo, hi, lower(substr(text, lo + 1, 1)) = 'i' AS iban, substr(text, hi + 1) AS rest, row_number() OVER (PARTITION BY rid ORDER BY lo) AS k
  FROM ({_spans("cue", 0, "account|Account|ACCOUNT|acct|Acct|ACCT|passport|Passport|PASSPORT|IBAN|iban|Iban")}) JOIN d USING (rid)),
numbers AS (
  SELECT rid, k, lo, iban,
         CASE WHEN iban THEN regexp_extract(rest, '^([A-Za-z]*[ :#=]{{0,3}})([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)', ['before', 'number'])
              ELSE regexp_extract(rest, '^([A-Za-z]*(?: ?(?:no|nr|number|id))?\.?[ :#=]{{1,3}})([A-Z]{{0,2}}[0-9]{{6,20}})(?:[^0-9A-Za-z]|$)', ['before', 'number']) END AS m,
         hi + length(m['before']) AS first, first + length(m['number']) AS last, replace(m['number'], ' ', '') AS s,
         m['number'] <> '' AND (NOT iban OR (length(s) BETWEEN 15 AND 34 AND
           list_reduce(string_split(substr(s, 5) || substr(s, 1, 4), ''),
             lambda a, c: (a * CASE WHEN c < 'A' THEN 10 ELSE 100 END + strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1) % 97, 0) = 1)) AS good
  FROM cues),
steps AS (
  SELECT rid, k, iban, first, last, good AS taken, CASE WHEN good THEN last ELSE 0 END AS reached FROM numbers WHERE k = 1
  UNION ALL
  SELECT n.rid, n.k, n.iban, n.first, n.last, n.good AND n.lo >= reached, CASE WHEN n.good AND n.lo >= reached THEN n.last ELSE reached END
  FROM steps JOIN numbers n ON n.rid = steps.rid AND n.k = steps.k + 1),
every AS (
  SELECT * FROM base UNION ALL SELECT * FROM urls
  UNION ALL SELECT rid, CASE WHEN iban THEN 'iban' ELSE 'account' END, CASE WHEN iban THEN 5 ELSE 6 END, first, last FROM steps WHERE taken),
joined AS (
  SELECT rid, count_if(kind = 'email') AS n_email, count_if(kind = 'ip') AS n_ip, count_if(kind = 'card') AS n_card, count_if(kind = 'phone') AS n_phone,
         {_LISTED} FILTER (ord < 4) AS base, {_LISTED} AS spans, count_if(kind <> 'url') AS n_personal
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_personal, 0)::BIGINT AS n_personal
FROM d LEFT JOIN joined USING (rid)
"""

OP8_SQL = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
p AS (SELECT rid, doc_id, (length(bytes) // 2)::BIGINT AS n_bytes, greatest((length(bytes) // 2 + 575) // 576, 1) * 576 AS n, rpad(bytes, (greatest((length(bytes) // 2 + 575) // 576, 1) * 1152)::INT, 'F') AS payload FROM d),
m AS (SELECT *, '52494646' || {_hex32("(n + 38)")} || '57415645666D74201200000007000100401F0000401F000001000800000064617461' || {_hex32("n")} || payload AS media FROM p),
codes AS (SELECT rid, unnest({_bytes("payload")}) AS b, generate_subscripts({_bytes("payload")}, 1) AS k FROM p),
samples AS (SELECT rid, k, CASE WHEN b < 128 THEN 132 - v ELSE v - 132 END AS x
  FROM (SELECT *, ((((255 - b) & 15) << 3) + 132) << (((255 - b) & 112) >> 4) AS v FROM codes)),
twice AS (SELECT rid, k, x, x + floor((coalesce(lead(x) OVER (PARTITION BY rid ORDER BY k), x) - x) / 2.0)::BIGINT AS y FROM samples),
turns AS (SELECT *, lag(y) OVER (PARTITION BY rid ORDER BY k) AS last FROM twice),
f AS (
  SELECT rid, 2 * count(*) AS n, (sum(abs(x) + abs(y)) * 1000 // (2 * count(*)))::BIGINT AS mean, greatest(max(abs(x)), max(abs(y))) AS peak,
         count_if((x < 0) <> (y < 0)) + count_if((last < 0) <> (x < 0)) AS crossings,
         flatten(list([x & 255, (x >> 8) & 255, y & 255, (y >> 8) & 255] ORDER BY k)) AS pcm
  FROM turns GROUP BY rid),
ima AS (
  SELECT rid, block, 0 AS step, raw, x, least(raw[3], 88) AS idx
  FROM (SELECT rid, block, raw, raw[1] + 256 * raw[2] - CASE WHEN raw[2] > 127 THEN 65536 ELSE 0 END AS x
    FROM (SELECT rid, (k - 1) // 36 AS block, list(b ORDER BY k) AS raw FROM codes GROUP BY rid, block))
  UNION ALL
  SELECT rid, block, step + 1, raw, least(greatest(x + CASE WHEN c & 8 = 8 THEN -change ELSE change END, -32768), 32767),
         least(greatest(idx + [-1, -1, -1, -1, 2, 4, 6, 8][(c & 7) + 1], 0), 88)
  FROM (SELECT *, (size >> 3) + CASE WHEN c & 4 = 4 THEN size ELSE 0 END + CASE WHEN c & 2 = 2 THEN size >> 1 ELSE 0 END + CASE WHEN c & 1 = 1 THEN size >> 2 ELSE 0 END AS change
    FROM (SELECT *, (raw[5 + step // 2] >> (4 * (step % 2))) & 15 AS c, {STEPS.tolist()}[idx + 1] AS size FROM ima WHERE step < 64))),
others AS (
  SELECT 'alaw' AS codec, rid, k, CASE WHEN c & 128 = 128 THEN v ELSE -v END AS x
  FROM (SELECT *, CASE WHEN c & 112 = 0 THEN ((c & 15) << 4) + 8 ELSE (((c & 15) << 4) + 264) << (((c & 112) >> 4) - 1) END AS v FROM (SELECT rid, k, xor(b, 85) AS c FROM codes))
  UNION ALL
  SELECT 'adpcm', rid, block * 65 + step + 1, x FROM ima),
o AS (
  SELECT codec, rid, 'n=' || count(*) || ';mean=' || (sum(abs(x)) * 1000 // count(*)) || ';peak=' || max(abs(x)) || ';crossings=' || count_if((x < 0) <> (last < 0))
         || ';weighted=' || sum(x * ((k - 1) % 1000 + 1)) AS feature
  FROM (SELECT *, lag(x) OVER (PARTITION BY codec, rid ORDER BY k) AS last FROM others) GROUP BY codec, rid)
SELECT doc_id, n_bytes, m.n::BIGINT AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, {_crc32(_bytes("right(payload, 64)"))} AS tail_crc32,
       (m.n + 46)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256,
       'n=' || f.n || ';mean=' || mean || ';peak=' || peak || ';crossings=' || crossings || ';pcm=' || printf('%08x', {_crc32("pcm")}) AS feature,
       (4 * m.n + 44)::BIGINT AS pcm_bytes, alaw.feature AS alaw_feature, adpcm.feature AS adpcm_feature
FROM m JOIN f USING (rid) JOIN o AS alaw ON alaw.rid = m.rid AND alaw.codec = 'alaw' JOIN o AS adpcm ON adpcm.rid = m.rid AND adpcm.codec = 'adpcm', crcs
"""



def _starts(width: int) -> str:
    """Each place of a string of so many bytes, with its digest."""
    return f"""SELECT rid, first + pos AS pos, md5_number(substr(piece, 2 * pos + 1, {2 * width})) AS gram
  FROM (SELECT rid, first, piece, unnest(range(length(piece) // 2 - {width - 1})) AS pos FROM (
    SELECT rid, first, substr(bytes, 2 * first + 1, {2 * (511 + width)}) AS piece FROM (SELECT rid, bytes, unnest(range(0, length(bytes) // 2 - {width - 1}, 512)) AS first FROM d)))"""


def _runs(of: str, twice: str, width: int) -> str:
    """Bytes that these strings cover, as [first, last)."""
    return f"""SELECT rid, min(pos) AS first, max(pos) + {width} AS last
  FROM (SELECT rid, pos, sum(opens::INT) OVER (PARTITION BY rid ORDER BY pos) AS run
    FROM (SELECT rid, pos, pos > lag(pos, 1, -{width + 1}) OVER (PARTITION BY rid ORDER BY pos) + {width} AS opens FROM {of} SEMI JOIN {twice} USING (gram)))
  GROUP BY rid, run"""


_SPACES = "('20', '09', '0A', '0B', '0C', '0D')"

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
starts AS ({_starts(400)}),
twice AS (SELECT gram FROM starts GROUP BY gram HAVING count(*) > 1),
runs AS ({_runs("starts", "twice", 400)}),
edges AS (SELECT rid, first, last, lag(last, 1, 0) OVER (PARTITION BY rid ORDER BY first) AS before FROM runs),
cut AS (
  SELECT rid, sum(last - first)::BIGINT AS n_removed, count(*) AS n_spans, max(last) AS tail,
         string_agg(substr(bytes, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS kept
  FROM edges JOIN d USING (rid) GROUP BY rid),
shorter AS ({_starts(240)}),
elsewhere AS (SELECT gram FROM shorter GROUP BY gram HAVING min(rid) < max(rid)),
shared AS ({_runs("shorter", "elsewhere", 240)}),
worded AS (SELECT rid, len(list_filter(range(1, len(l) + 1), lambda k: l[k] NOT IN {_SPACES} AND (k = 1 OR l[k - 1] IN {_SPACES}))) AS words
  FROM (SELECT rid, regexp_extract_all(substr(bytes, 2 * first + 1, 2 * (last - first)), '..') AS l FROM shared JOIN d USING (rid))),
passages AS (SELECT rid, sum(words)::BIGINT AS passage_words FROM worded WHERE words > 50 GROUP BY rid)
SELECT doc_id, (length(bytes) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN bytes ELSE kept || substr(bytes, 2 * tail + 1) END)) AS kept_sha256,
       coalesce(passage_words, 0) AS passage_words
FROM d LEFT JOIN cut USING (rid) LEFT JOIN passages USING (rid)
"""
