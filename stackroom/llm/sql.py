"""DuckDB SQL for the operators that SQL can express."""

URL_VERDICTS = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (SELECT * FROM fits WHERE place = 1)
SELECT s.page_id, s.host, s.path, b.rule,
       CASE WHEN b.rule IS NOT NULL THEN b.verdict
            WHEN regexp_matches(s.host || s.path, '^(?:[^/]*\.)?(?:cheap-pills|spam-farm|ads(?:[^a-zA-Z0-9_.%-]|\z)|tracker(?:[^a-zA-Z0-9_.%-]|\z))')
                 AND (regexp_matches(s.host || s.path, '^(?:[^/]*\.)?(?:cheap-pills|spam-farm)\.')
                      OR regexp_matches(s.host || s.path, '^(?:[^/]*\.)?(?:ads|tracker)(?:[^a-zA-Z0-9_.%-]|\z)')) THEN 'block'
            WHEN regexp_matches(s.host || s.path, '^(?:[^/]*\.)?casino(?s:.*)\.') THEN 'block'
            WHEN ends_with(s.host || s.path, '/wp-login.php') THEN 'block'
            ELSE 'allow' END AS verdict,
       CASE WHEN b.rule IS NOT NULL THEN '||' || b.rule
            WHEN regexp_matches(s.host || s.path, '^(?:[^/]*\.)?(?:cheap-pills)\.') THEN '||cheap-pills.'
            WHEN regexp_matches(s.host || s.path, '^(?:[^/]*\.)?(?:spam-farm)\.') THEN '||spam-farm.'
            WHEN regexp_matches(s.host || s.path, '^(?:[^/]*\.)?casino(?s:.*)\.') THEN '||casino*.'
            WHEN ends_with(s.host || s.path, '/wp-login.php') THEN '/wp-login.php|'
            WHEN regexp_matches(s.host || s.path, '^(?:[^/]*\.)?ads(?:[^a-zA-Z0-9_.%-]|\z)') THEN '||ads^'
            WHEN regexp_matches(s.host || s.path, '^(?:[^/]*\.)?tracker(?:[^a-zA-Z0-9_.%-]|\z)') THEN '||tracker^'
       END AS pattern
FROM split s LEFT JOIN best b ON s.page_id = b.page_id AND s.host = b.host AND s.path = b.path
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, role = 'assistant' AS reply,
         row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         3 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) + 1
           + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'))
           + CASE WHEN role = 'assistant' THEN 4 ELSE 19 END AS size
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE reply), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE reply), '')) AS loss_sha256,
       sum(CASE WHEN reply OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""

WARC = r"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS response, count(*) OVER (PARTITION BY html) AS n FROM rows)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         ((strpos('0123456789abcdef', substr(hex || '00', 1 + (5 * i) // 4, 1)) - 1) * 256
          + (strpos('0123456789abcdef', substr(hex || '00', 2 + (5 * i) // 4, 1)) - 1) * 16
          + (strpos('0123456789abcdef', substr(hex || '00', 3 + (5 * i) // 4, 1)) - 1))
         >> (7 - (5 * i) % 4)) % 32, 1)), '') AS payload_digest,
       CASE WHEN page_id = response OR response IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response OR response IS NULL THEN NULL ELSE response END AS refers_to
FROM best
"""
