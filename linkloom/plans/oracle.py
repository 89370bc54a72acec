"""SQL twins of the queries, for an independent engine over the same tables."""

from __future__ import annotations

# Percent-encoded path, character by character.
_ENCODED = r"""
CASE WHEN regexp_full_match(href, '[A-Za-z0-9._~!$&''()*+,;=:@\[\]%/-]*') THEN href
ELSE array_to_string(list_transform(string_split(href, ''), lambda c:
  CASE WHEN regexp_full_match(c, '[A-Za-z0-9._~$&+,/:;=@-]') THEN c
  ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') END
"""

_LINKS = rf"""
hrefs AS (
  SELECT DISTINCT page_id, url, replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '&amp;', '&') AS href
  FROM pages),
page_links AS (
  SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+') || {_ENCODED} AS link FROM hrefs)
"""

_FRONTIER = rf"""
{_LINKS},
items AS (
  SELECT page_id, regexp_replace(url, '#.*$', '') AS url, 1 AS depth, starts_with(url, 'http:') AS plain FROM pages
  UNION ALL SELECT page_id, link, 2, starts_with(url, 'http:') FROM page_links),
numbered AS (
  SELECT *, page_id + (depth - 1) * 1000000000000 AS seq, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS domain,
    depth AS priority, 0 AS retry_count, CASE WHEN plain THEN 'QUEUED' ELSE 'CRAWLED' END AS status,
    epoch_us(TIMESTAMP '2024-01-01 00:00:00') + page_id * 1000000 AS added_at
  FROM items),
frontier AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
"""

_FRONTIER_COLUMNS = "url, domain, depth, priority, retry_count, status, added_at"

_ROBOTS = r"""
hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS domain FROM pages),
served AS (SELECT domain, length(domain) % 2 = 0 AS own FROM hosts WHERE length(domain) % 7 <> 0),
shared_rules(pos, allow, path, shape) AS (VALUES
  (1, false, '/fr/', '/fr/.*'), (2, true, '/fr/1', '/fr/1.*'), (3, false, '/*.html$', '/.*\.html')),
rules AS (
  SELECT domain, '*' AS agent, pos, allow, path, shape, 1.5 AS crawl_delay FROM served, shared_rules WHERE NOT own
  UNION ALL SELECT domain, 'linkbot', 7, false, '/en/*5', '/en/.*5.*', 2.0 FROM served WHERE own)
"""

_TESTED = rf"""
{_FRONTIER}, {_ROBOTS},
decided AS (
  SELECT f.url, arg_max(r.allow, length(r.path) * 2 + r.allow::INT) AS allow
  FROM frontier f JOIN rules r ON lower(f.domain) = r.domain
    AND regexp_full_match(url_decode(regexp_extract(f.url, '^https?://[^/?#]+([^?#]*)', 1)), r.shape)
  GROUP BY f.url),
delays AS (SELECT DISTINCT domain, crawl_delay FROM rules),
tested AS (
  SELECT f.url, f.depth, coalesce(d.allow, true) AS allowed, coalesce(w.crawl_delay, 0.0)::DOUBLE AS crawl_delay
  FROM frontier f LEFT JOIN decided d ON f.url = d.url LEFT JOIN delays w ON lower(f.domain) = w.domain)
"""

_SITE = r"""
        WITH RECURSIVE
        page AS (
          SELECT 'https://region.example.com/' || r_regionkey AS url, 200 AS code FROM region
          UNION ALL SELECT 'https://nation.example.com/' || n_nationkey, 200 FROM nation
          UNION ALL SELECT 'https://customer.example.com/' || c_custkey, 200 FROM customer
          UNION ALL SELECT 'https://order.example.com/' || o_orderkey,
            CASE o_orderstatus WHEN 'F' THEN 410 ELSE 200 END FROM orders
          UNION ALL SELECT 'https://part.example.com/' || p_partkey, 200 FROM part),
        link AS (
          SELECT 'https://region.example.com/' || n_regionkey AS src, 'https://nation.example.com/' || n_nationkey AS dst
            FROM nation
          UNION SELECT 'https://nation.example.com/' || n_nationkey, 'https://region.example.com/' || n_regionkey FROM nation
          UNION SELECT 'https://nation.example.com/' || c_nationkey, 'https://customer.example.com/' || c_custkey
            FROM customer
          UNION SELECT 'https://customer.example.com/' || o_custkey, 'https://order.example.com/' || o_orderkey FROM orders
          UNION SELECT 'https://order.example.com/' || o_orderkey, 'https://customer.example.com/' || o_custkey FROM orders
          UNION SELECT 'https://order.example.com/' || l_orderkey, 'https://part.example.com/' || l_partkey FROM lineitem),
        open_link AS (SELECT src, dst FROM link JOIN page ON src = url WHERE code < 400),
"""

_SNAPSHOT = r"""
snapshot AS (
  SELECT regexp_replace(url, '#.*$', '') AS url, CASE WHEN url LIKE '%utm_source%' THEN 404 ELSE 200 END AS status_code,
    octet_length(encode(html)) AS n_bytes, octet_length(encode(html)) * 1000 + 999999 AS fetch_time_ns
  FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '') ORDER BY page_id) = 1)
"""

_LOG = r"""
log AS (
  SELECT event_id, ts, epoch_us(ts) AS at_us, 'u' || user_id || '.example.com' AS domain,
    'https://u' || user_id || '.example.com/' || event_type AS url, (user_id % 3 + 1)::INT AS depth,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 0 ELSE 200 END AS status_code,
    CASE event_type WHEN 'signup' THEN 'fetch error: timeout' ELSE '' END AS error,
    round(value * 1000)::BIGINT * 1000 + 7 AS fetch_time_ns, length(props) AS bytes,
    CASE event_type WHEN 'purchase' THEN 'QUEUED' ELSE 'CRAWLED' END AS status
  FROM events)
"""

_TICKS = r"""
ticks AS (
  SELECT event_id, 'crawl' || user_id AS crawl, ts,
    CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS active_workers,
    CASE event_type WHEN 'signup' THEN 3 ELSE 0 END AS queue_length,
    CASE WHEN event_type = 'error' AND value > 50 THEN 1 ELSE 0 END AS in_flight
  FROM events)
"""

_SHOP = r"""
shop AS (
  SELECT 'https://shop.example.com/supplier/' || l_suppkey || '/part/' || l_partkey AS url, l_returnflag FROM lineitem)
"""

_VARIANTS = r"""
variants AS (
  SELECT l_orderkey, l_linenumber, l_suppkey AS s FROM lineitem)
"""

_RESULTS = r"""
results AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS domain, html,
    octet_length(encode(html)) AS n_bytes, 1704067200 + page_id AS at_s
  FROM pages WHERE url NOT LIKE '%utm_source%' AND url NOT LIKE '%#top' AND html <> '')
"""

_STATS = rf"""
{_LOG},
hours AS (
  SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS pages,
    count(*) FILTER (WHERE error <> '' OR status_code >= 400) AS errors, sum(bytes)::BIGINT AS bytes
  FROM log GROUP BY 1)
"""

_BLOOM = rf"""
{_SHOP},
size AS (SELECT ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) AS m, count(*) AS n FROM lineitem),
shape AS (SELECT ceil(m / 32768)::BIGINT AS blocks, ceil(m / n * ln(2))::BIGINT AS k FROM size),
hashed AS (
  SELECT ('0x' || substr(md5(url), 1, 8))::BIGINT % blocks AS block, ('0x' || substr(md5(url), 9, 8))::BIGINT AS h1,
    ('0x' || substr(md5(url), 17, 8))::BIGINT | 1 AS h2, k
  FROM (SELECT DISTINCT url FROM shop), shape),
bits AS (SELECT block, (h1 + i * h2) % 32768 AS bit, i FROM (SELECT *, unnest(range(k)) AS i FROM hashed))
"""

_LE = ", ".join(
    f"('{le}', {bound})"
    for le, bound in [
        ("0.005", 0.005), ("0.01", 0.01), ("0.025", 0.025), ("0.05", 0.05), ("0.1", 0.1), ("0.25", 0.25),
        ("0.5", 0.5), ("1", 1), ("2.5", 2.5), ("5", 5), ("10", 10), ("+Inf", "1e300"),
    ]
)

ORACLE: dict[str, str] = {
    "extract_links": f"WITH {_LINKS} SELECT DISTINCT page_id, url, link FROM page_links",
    "page_link_counts": f"""WITH {_LINKS}
        SELECT p.page_id, count(DISTINCT l.link) AS links FROM pages p LEFT JOIN page_links l ON p.page_id = l.page_id
        GROUP BY p.page_id""",
    "distinct_links": f"WITH {_LINKS} SELECT DISTINCT link FROM page_links",
    "domain_counts": f"""WITH {_LINKS}
        SELECT regexp_extract(link, '^https?://([^/?#:]+)', 1) AS domain, count(DISTINCT link) AS count
        FROM page_links GROUP BY 1""",
    "resolve_reference": r"""
        WITH found AS (
          SELECT page_id, url, list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS distinct_hrefs,
            regexp_extract_all(html, '<a href="([^"]*)"', 1) AS all_hrefs FROM pages),
        each_href AS (
          SELECT page_id, url, unnest(all_hrefs) AS h, unnest(range(len(all_hrefs))) AS i FROM found),
        first_href AS (SELECT page_id, url, h, min(i) AS i FROM each_href GROUP BY 1, 2, 3),
        hrefs AS (
          SELECT page_id, url, replace(h, '&amp;', '&') AS h,
            (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos FROM first_href),
        refs AS (
          SELECT *, CASE pos % 5 WHEN 0 THEN h WHEN 1 THEN '..' || h WHEN 2 THEN '.' || h WHEN 3 THEN '../..' || h
              ELSE substr(h, 2) END AS ref,
            regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '[^/]*$', '') AS dir FROM hrefs),
        placed AS (
          SELECT page_id, pos, ref, CASE pos % 5 WHEN 0 THEN h
            WHEN 1 THEN regexp_replace(dir, '[^/]+/$', '') || substr(h, 2)
            WHEN 3 THEN regexp_replace(regexp_replace(dir, '[^/]+/$', ''), '[^/]+/$', '') || substr(h, 2)
            ELSE dir || substr(h, 2) END AS href FROM refs)
        SELECT page_id, pos, ref, """ + _ENCODED + " AS path FROM placed",
    "canonicalize_url": r"""
        SELECT l_orderkey, l_linenumber, CASE l_linenumber
          WHEN 1 THEN 'https://shop.example.com:8443/a/p/' || l_partkey
          WHEN 2 THEN 'https://cdn.example.org/s/' || l_suppkey || '?x=1'
          WHEN 3 THEN 'https://shop.example.com:8443/a/b/' || l_orderkey || '?page=' || l_partkey
          WHEN 4 THEN 'https://shop.example.com:8443/a/b/' || l_orderkey || '?v=2'
          WHEN 5 THEN 'http://h.example.com/%C3%A9/' || l_partkey
          WHEN 6 THEN NULL
          ELSE 'https://shop.example.com:8443/p%20q/' END AS url
        FROM lineitem""",
    "href_filter": "SELECT l_orderkey, l_linenumber, l_linenumber IN (5, 6) AS navigational FROM lineitem",
    "normalize_host": f"""WITH {_VARIANTS} SELECT l_orderkey, l_linenumber, CASE
          WHEN l_linenumber IN (1, 2, 5) THEN 's' || s || '.example.com'
          WHEN l_linenumber = 3 THEN 's' || s || '.example.com:8080'
          WHEN l_linenumber = 4 THEN 's' || s || '.example.com:443'
          WHEN l_linenumber = 6 THEN '[2001:db8::' || (s % 10) || ']'
          ELSE '' END AS host FROM variants""",
    "url_hostname": f"""WITH {_VARIANTS} SELECT l_orderkey, l_linenumber, CASE
          WHEN l_linenumber < 6 THEN 'S' || s || '.Example.COM'
          WHEN l_linenumber = 6 THEN '2001:DB8::' || (s % 10)
          ELSE '' END AS hostname FROM variants""",
    "url_domain_text": f"""WITH {_VARIANTS} SELECT l_orderkey, l_linenumber, CASE
          WHEN l_linenumber = 3 THEN 'User:Pw@S' || s || '.Example.COM'
          WHEN l_linenumber < 6 THEN 'S' || s || '.Example.COM'
          WHEN l_linenumber = 6 THEN '[2001:DB8::' || (s % 10) || ']'
          ELSE '' END AS domain FROM variants""",
    "seed_normalize": r"""
        WITH requests AS (SELECT o_orderkey, o_orderkey % 6 AS form, o_custkey AS c, o_orderkey % 5 - 1 AS d FROM orders)
        SELECT o_orderkey,
          CASE form WHEN 0 THEN 'https://shop' || c || '.example.com/o/' || o_orderkey
            WHEN 1 THEN 'http://Shop' || c || '.example.com'
            WHEN 5 THEN 'https://HTTP://x.example.com/' || o_orderkey END AS seed_url,
          CASE form WHEN 0 THEN 'shop' || c || '.example.com' WHEN 1 THEN 'Shop' || c || '.example.com'
            WHEN 5 THEN 'HTTP' END AS domain,
          CASE WHEN d <= 0 THEN 3 ELSE d END::INT AS max_depth,
          CASE WHEN form = 3 THEN 'URL is required' WHEN form IN (2, 4) THEN 'Invalid URL format' ELSE '' END AS reason
        FROM requests""",
    "seed_submit": r"""
        WITH requests AS (
          SELECT o_orderkey, o_orderstatus,
            'https://shop' || (o_custkey % 100) || '.example.com/c/' || o_custkey AS site FROM orders),
        seen AS (SELECT DISTINCT site FROM requests WHERE o_orderstatus = 'P'),
        offered AS (
          SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE site END AS url FROM requests),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY o_orderkey) AS nth FROM offered),
        judged AS (SELECT *, url <> '' AND nth = 1 AND url NOT IN (SELECT site FROM seen) AS accepted FROM ranked)
        SELECT o_orderkey, accepted,
          CASE WHEN url = '' THEN 'URL is required' WHEN accepted THEN 'Seed URL queued: ' || url || ' (Depth: 2)'
            ELSE 'URL already crawled or queued in frontier' END AS message,
          CASE WHEN url = '' THEN NULL WHEN accepted THEN 'QUEUED' ELSE 'ALREADY IN FRONTIER' END AS log_status
        FROM judged""",
    "frontier_dump": f"""WITH {_FRONTIER}
        SELECT row_number() OVER (ORDER BY url) AS n, 'url:' || url AS key,
          '{{"url":"' || url || '","domain":"' || domain || '","depth":' || depth || ',"priority":' || priority
          || ',"retry_count":0,"status":"' || status || '","added_at":"'
          || strftime(make_timestamp(added_at), '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS value,
          count(*) OVER () AS total FROM frontier""",
    "frontier_scan_status": f"""WITH {_FRONTIER}
        SELECT {_FRONTIER_COLUMNS} FROM frontier WHERE status = 'CRAWLED' ORDER BY url LIMIT 500""",
    "frontier_scan_domain": f"""WITH {_FRONTIER}
        SELECT {_FRONTIER_COLUMNS} FROM frontier WHERE domain = 'www.cheap-pills.example.com' AND status = 'QUEUED'
        ORDER BY url""",
    "frontier_prefix_scan": f"""WITH {_FRONTIER}
        SELECT {_FRONTIER_COLUMNS} FROM frontier WHERE starts_with(url, 'https://blog.') ORDER BY url""",
    "frontier_lookup": f"""WITH {_FRONTIER}
        SELECT p.url, f.url IS NOT NULL AS found, f.depth, f.status FROM pages p LEFT JOIN frontier f ON p.url = f.url""",
    "frontier_decode": r"""
        WITH stored AS (
          SELECT url, ends_with(url, '.html') AS short FROM pages WHERE url NOT LIKE '%?page%' AND url NOT LIKE '%#top')
        SELECT url, CASE WHEN short THEN '' ELSE 'd' END AS domain, CASE WHEN short THEN 2 ELSE 1 END AS depth,
          CASE WHEN short THEN 0 ELSE 2 END AS priority, 0 AS retry_count,
          CASE WHEN short THEN '' ELSE 'QUEUED' END AS status
        FROM stored""",
    "domain_counts_status": f"""WITH {_FRONTIER}
        SELECT domain, count(*) AS count FROM frontier WHERE status = 'CRAWLED' GROUP BY 1""",
    "frontier_upsert": f"""WITH {_FRONTIER},
        versions AS (
          SELECT url, 'QUEUED' AS status, depth, 0 AS version FROM frontier
          UNION ALL SELECT regexp_replace(url, '#.*$', ''), 'CRAWLED', 1, page_id + 1 FROM pages)
        SELECT url, status, depth, version FROM versions
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY version DESC) = 1""",
    "frontier_push": f"""WITH {_FRONTIER},
        offered AS (
          SELECT url, seq, depth FROM numbered
          UNION ALL SELECT DISTINCT '', seq, depth FROM numbered WHERE depth = 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS nth FROM offered)
        SELECT url, seq, depth, nth = 1 AND url <> '' AND url NOT IN (
          SELECT regexp_replace(url, '#.*$', '') FROM pages WHERE url LIKE '%spam-farm%') AS pushed FROM ranked""",
    "dedup_against_seen": f"""WITH {_SHOP}
        SELECT url FROM shop WHERE l_returnflag <> 'R' EXCEPT SELECT url FROM shop WHERE l_returnflag = 'R'""",
    "session_dedup": f"""WITH {_LOG}, {_TICKS},
        settled AS (
          SELECT *, active_workers > 0 OR queue_length > 0 AS active FROM ticks
          WHERE active_workers > 0 OR queue_length > 0 OR in_flight = 0),
        paired AS (SELECT *, lag(active) OVER (PARTITION BY crawl ORDER BY ts, event_id) AS was FROM settled),
        edges AS (SELECT event_id, epoch_us(ts) AS ended FROM paired WHERE NOT active AND was),
        placed AS (
          SELECT 'crawl' || regexp_extract(domain, '^u([0-9]+)', 1) AS crawl, at_us, event_id, url,
            coalesce(max(ended) OVER (PARTITION BY domain ORDER BY at_us, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session_start_us
          FROM log LEFT JOIN edges USING (event_id))
        SELECT crawl, session_start_us, url, event_id FROM placed
        QUALIFY row_number() OVER (PARTITION BY crawl, session_start_us, url ORDER BY at_us, event_id) = 1""",
    "robots_parse": f"WITH {_ROBOTS} SELECT domain, agent, pos, allow, path, crawl_delay::DOUBLE AS crawl_delay FROM rules",
    "robots_allowed": f"WITH {_TESTED} SELECT url, allowed, crawl_delay FROM tested",
    "robots_blocked": f"WITH {_TESTED} SELECT count(*) FILTER (WHERE NOT allowed) AS robots_blocked FROM tested",
    "fetch_snapshot": f"""WITH {_FRONTIER}, {_SNAPSHOT}
        SELECT f.url, f.depth, coalesce(s.status_code, 0) AS status_code,
          CASE WHEN s.url IS NULL THEN '' ELSE 'text/html; charset=utf-8' END AS content_type, s.n_bytes,
          coalesce(s.fetch_time_ns, 0) AS fetch_time_ns,
          CASE WHEN s.url IS NULL THEN 'fetch error: no response captured' ELSE '' END AS error
        FROM frontier f LEFT JOIN snapshot s ON f.url = s.url""",
    "fetch_outcome": f"""WITH {_TESTED}, {_SNAPSHOT}
        SELECT t.url, t.depth, CASE WHEN NOT t.allowed THEN 'BLOCKED' WHEN s.url IS NULL OR s.status_code >= 400 THEN 'ERROR'
          ELSE s.status_code::VARCHAR END AS outcome
        FROM tested t LEFT JOIN snapshot s ON t.url = s.url""",
    "crawl_reachable": rf"""{_SITE}
        walk AS (
          SELECT 'https://region.example.com/' || r_regionkey AS url, 1 AS depth FROM region
          UNION SELECT o.dst, w.depth + 1 FROM walk w JOIN open_link o ON w.url = o.src WHERE w.depth < 5),
        least AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
        SELECT l.url, regexp_extract(l.url, '^https://([^/]+)', 1) AS domain, l.depth,
          CASE WHEN p.url IS NULL OR p.code >= 400 THEN 'ERROR' ELSE p.code::VARCHAR END AS outcome
        FROM least l LEFT JOIN page p ON l.url = p.url""",
    "crawl_limits": rf"""{_SITE}
        walk AS (
          SELECT 'https://region.example.com/' || r_regionkey AS url, 1 AS depth, r_regionkey % 4 + 1 AS most FROM region
          UNION SELECT 'https://nation.example.com/' || n_nationkey, 1, n_nationkey % 3 + 1 FROM nation
          UNION SELECT o.dst, w.depth + 1, w.most FROM walk w JOIN open_link o ON w.url = o.src WHERE w.depth < w.most),
        least AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
        SELECT l.url, regexp_extract(l.url, '^https://([^/]+)', 1) AS domain, l.depth,
          CASE WHEN p.url IS NULL OR p.code >= 400 THEN 'ERROR' ELSE p.code::VARCHAR END AS outcome
        FROM least l LEFT JOIN page p ON l.url = p.url""",
    "crawl_pages": rf"""WITH RECURSIVE {_TESTED}, {_SNAPSHOT},
        edges AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, link AS dst FROM page_links),
        judged AS (
          SELECT t.url, t.allowed, s.url IS NOT NULL AS hit, s.status_code, s.n_bytes
          FROM tested t LEFT JOIN snapshot s ON t.url = s.url),
        open_edge AS (
          SELECT src, dst FROM edges JOIN judged ON src = url WHERE allowed AND hit AND status_code < 400 AND n_bytes > 0),
        own AS (SELECT regexp_replace(url, '#.*$', '') AS url FROM pages),
        walk AS (
          SELECT min(url) AS url, 1 AS depth FROM own GROUP BY regexp_extract(url, '^https?://([^/?#:]+)', 1)
          UNION SELECT o.dst, w.depth + 1 FROM walk w JOIN open_edge o ON w.url = o.src WHERE w.depth < 3),
        least AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
        SELECT l.url, regexp_extract(l.url, '^https?://([^/?#:]+)', 1) AS domain, l.depth,
          CASE WHEN NOT allowed THEN 'BLOCKED' WHEN NOT hit OR status_code >= 400 THEN 'ERROR'
            ELSE status_code::VARCHAR END AS outcome,
          coalesce(status_code, 0) AS status_code,
          CASE WHEN hit THEN '' ELSE 'fetch error: no response captured' END AS error, n_bytes
        FROM least l JOIN judged j ON l.url = j.url""",
    "bytes_fetched": "SELECT sum(octet_length(encode(html)))::BIGINT AS bytes_fetched FROM pages",
    "archive_sizes": "SELECT page_id, printf('%.2f MB', octet_length(encode(html)) / 1024 / 1024) AS size_mb FROM pages",
    "archive_select": f"WITH {_RESULTS} SELECT page_id, url, 200 AS status_code, n_bytes FROM results",
    "warc_record_format": rf"""WITH {_RESULTS},
        blocks AS (
          SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
            || 'Content-Length: ' || n_bytes || chr(13) || chr(10) || chr(13) || chr(10) AS http,
            md5(url || ' ' || (at_s * 1000000)) AS digest FROM results)
        SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
          || 'WARC-Record-ID: <urn:uuid:' || substr(digest, 1, 8) || '-' || substr(digest, 9, 4) || '-'
          || substr(digest, 13, 4) || '-' || substr(digest, 17, 4) || '-' || substr(digest, 21) || '>'
          || chr(13) || chr(10) || 'WARC-Date: ' || strftime(make_timestamp(at_s * 1000000), '%Y-%m-%dT%H:%M:%SZ')
          || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
          || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
          || 'Content-Length: ' || (n_bytes + octet_length(encode(http))) || chr(13) || chr(10) || chr(13) || chr(10)
          AS header, http FROM blocks""",
    "publish_plan": r"""
        WITH files AS (
          SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS domain,
            'crawl_' || strftime(make_timestamp((1704067200 + page_id // 2) * 1000000), '%Y%m%d_%H%M%S') || '.warc.gz'
            AS name FROM pages)
        SELECT '/archive/' || domain || '/' || name AS path, domain, 'warc/' || domain || '/' || name AS key,
          'r2://web-archive/warc/' || domain || '/' || name AS uri, 'application/gzip' AS content_type,
          count(*) OVER (PARTITION BY name) > 1 AS collides FROM files""",
    "archive_preview": rf"""WITH {_RESULTS},
        firsts AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY domain ORDER BY url, at_s) = 1),
        named AS (SELECT domain, md5(url || ' ' || (at_s * 1000000)) AS d FROM firsts)
        SELECT domain, 1::BIGINT AS line_no, 'WARC/1.0' AS line FROM named
        UNION ALL SELECT domain, 2, 'WARC-Type: response' FROM named
        UNION ALL SELECT domain, 3, 'WARC-Record-ID: <urn:uuid:' || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-'
          || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21) || '>' FROM named""",
    "archive_manifest": rf"""WITH {_RESULTS}
        SELECT domain, count(*) AS records, sum(n_bytes + length('HTTP/1.1 200 OK') + length('Content-Type: text/html')
          + length('Content-Length: ' || n_bytes) + 8)::BIGINT AS content_bytes FROM results GROUP BY domain""",
    "archive_listing": rf"""WITH {_RESULTS}
        SELECT DISTINCT domain, true AS has_files FROM results UNION ALL SELECT 'unsorted', false""",
    "header_map": r"""
        WITH last AS (
          SELECT l_orderkey, l_returnflag || '-' || l_linestatus AS name, l_partkey::VARCHAR AS value FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, name ORDER BY l_linenumber DESC, value DESC) = 1)
        SELECT l_orderkey, string_agg(name || '=' || value, ';' ORDER BY name) AS headers FROM last GROUP BY 1""",
    "archive_line_range": r"""
        WITH split AS (
          SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM documents),
        numbered AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM split)
        SELECT doc_id, line_no, regexp_replace(line, '\r$', '') AS line FROM numbered WHERE line_no BETWEEN 2 AND 4""",
    "warc_roundtrip": f"""WITH {_RESULTS}
        SELECT domain, url AS target_uri, 200 AS http_status, n_bytes, md5(html) AS digest,
          at_s * 1000000 AS date_us FROM results""",
    "warc_source": f"""WITH {_RESULTS}
        SELECT domain, url AS target_uri, 200 AS http_status, n_bytes, md5(html) AS digest,
          at_s * 1000000 AS date_us FROM results""",
    "archive_fetch": f"""WITH {_RESULTS},
        firsts AS (SELECT min(url) AS url FROM results GROUP BY domain)
        SELECT domain, url AS target_uri, 200 AS http_status, n_bytes, md5(html) AS digest,
          at_s * 1000000 AS date_us, true AS own_bytes_only FROM results WHERE url IN (SELECT url FROM firsts)""",
    "crawl_records": f"""WITH {_LOG}
        SELECT url, domain, status_code, depth, fetch_time_ns // 1000000 AS fetch_time_ms, error FROM log""",
    "pages_by_status": f"""WITH {_LOG}
        SELECT CASE status_code WHEN 0 THEN 'ERROR' ELSE status_code::VARCHAR END AS status, count(*) AS pages
        FROM log GROUP BY 1""",
    "status_label": f"""WITH {_LOG}
        SELECT event_id, CASE status_code WHEN 0 THEN 'ERROR' ELSE status_code::VARCHAR END AS label FROM log""",
    "latency_histogram": f"""WITH {_LOG}, bounds(le, upper) AS (VALUES {_LE}),
        total AS (SELECT round(sum(fetch_time_ns / 1e9), 6) AS sum_seconds, count(*) AS count FROM log)
        SELECT le, (SELECT count(*) FROM log WHERE fetch_time_ns / 1e9 <= upper) AS bucket_count, sum_seconds, count
        FROM bounds, total""",
    "crawl_stats": f"""WITH {_LOG}
        SELECT count(*) FILTER (WHERE status = 'CRAWLED') AS total_crawled,
          count(*) FILTER (WHERE status = 'QUEUED') AS total_queued,
          count(*) FILTER (WHERE error <> '' OR status_code >= 400) AS total_errors, sum(bytes)::BIGINT AS bytes_fetched,
          round(count(*) FILTER (WHERE status = 'CRAWLED') / ((max(at_us) - min(at_us)) / 1e6), 9) AS pages_per_sec,
          (max(at_us) - min(at_us)) * 1000 AS uptime_ns FROM log""",
    "gauge_last": f"""WITH {_TICKS}
        SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, arg_max(active_workers, ts) AS active_workers,
          arg_max(queue_length, ts) AS queue_length FROM ticks GROUP BY 1""",
    "stats_tumbling": f"WITH {_STATS} SELECT window_start, pages, errors, bytes FROM hours",
    "idle_sessions": f"""WITH {_LOG},
        steps AS (
          SELECT *, CASE WHEN at_us - lag(at_us) OVER w > 21600000000 OR lag(at_us) OVER w IS NULL THEN 1 ELSE 0 END
            AS opens FROM log WINDOW w AS (PARTITION BY domain ORDER BY at_us, event_id)),
        marked AS (
          SELECT *, sum(opens) OVER (PARTITION BY domain ORDER BY at_us, event_id) AS session FROM steps)
        SELECT domain, min(at_us) AS start_us, max(at_us) AS end_us, count(*) AS pages FROM marked GROUP BY domain, session""",
    "completion_events": f"""WITH {_TICKS},
        settled AS (
          SELECT *, active_workers > 0 OR queue_length > 0 AS active FROM ticks
          WHERE active_workers > 0 OR queue_length > 0 OR in_flight = 0),
        paired AS (SELECT *, lag(active) OVER (PARTITION BY crawl ORDER BY ts, event_id) AS was FROM settled)
        SELECT crawl, epoch_us(ts) AS ts FROM paired WHERE NOT active AND was""",
    "politeness_plan": f"""WITH {_LOG},
        ranked AS (
          SELECT event_id, domain, at_us, row_number() OVER w AS i FROM log
          WINDOW w AS (PARTITION BY domain ORDER BY at_us, event_id))
        SELECT event_id, domain, at_us, i * 21600000000 + max(at_us - i * 21600000000) OVER (
          PARTITION BY domain ORDER BY i) AS release_us FROM ranked""",
    "politeness_violations": f"""WITH {_LOG},
        paired AS (
          SELECT event_id, domain, at_us, at_us - lag(at_us) OVER (PARTITION BY domain ORDER BY at_us, event_id) AS gap_us
          FROM log)
        SELECT * FROM paired WHERE gap_us < 21600000000""",
    "log_events": f"""WITH {_LOG}
        SELECT '{{"type":"log","time":"' || strftime(ts, '%H:%M:%S') || '","url":"' || url || '","status":"' || status
          || '","depth":' || depth || '}}' AS event FROM log""",
    "stats_events": f"""WITH {_STATS}
        SELECT '{{"type":"stats","active_workers":0,"total_crawled":' || pages || ',"total_queued":' || (bytes - pages)
          || ',"total_errors":' || errors || '}}' AS event FROM hours""",
    "bloom_build": f"""WITH {_BLOOM}
        SELECT block, count(*) FILTER (WHERE i = 0) AS added, count(DISTINCT bit) AS bits_set FROM bits GROUP BY block""",
    "bloom_might_contain": f"WITH {_SHOP} SELECT true AS maybe, count(*) AS urls FROM shop",
    "bloom_dedup": f"""WITH {_SHOP}
        SELECT url FROM shop WHERE l_returnflag <> 'R' EXCEPT SELECT url FROM shop WHERE l_returnflag = 'R'""",
}
ORACLE["crawl_log"] = f"""WITH visited AS ({ORACLE["crawl_pages"]}),
        asked AS (
          SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY url) - 1) * 500000 + coalesce(n_bytes, 0) AS done_us
          FROM visited WHERE outcome <> 'BLOCKED'),
        timed AS (
          SELECT url, outcome AS status, depth, done_us FROM asked
          UNION ALL SELECT url, outcome, depth, 0 FROM visited WHERE outcome = 'BLOCKED'),
        logged AS (
          SELECT * FROM timed UNION ALL SELECT '', 'SUCCESS', 0, (max(done_us) // 500000 + 1) * 500000 FROM timed)
        SELECT '{{"type":"log","time":"' || strftime(make_timestamp(1704067200000000 + done_us), '%H:%M:%S') || '","url":"'
          || url || '","status":"' || status || '","depth":' || depth || '}}' AS event FROM logged"""
ORACLE["frontier_buckets"] = ORACLE["frontier_upsert"]
ORACLE["archive_files"] = f"""WITH counted AS ({ORACLE["archive_manifest"]})
        SELECT domain, true AS is_part, true AS same_size, true AS same_text, records, content_bytes FROM counted
        UNION ALL SELECT 'unsorted', NULL, NULL, NULL, NULL, NULL"""
ORACLE["store_overview"] = f"""WITH {_FRONTIER}, {_RESULTS},
        entries AS (
          SELECT 'frontier_domains' AS section, domain, 'count' AS name, count(*) AS n FROM frontier GROUP BY domain
          UNION ALL SELECT DISTINCT 'warc_domains', domain, 'files', 1 FROM results
          UNION ALL SELECT 'warc_domains', 'unsorted', 'files', 0)
        SELECT section, '{{"domain":"' || domain || '","' || name || '":' || n || '}}' AS entry FROM entries"""
ORACLE["crawl_records_stored"] = f"""WITH {_LOG}
        SELECT domain, count(*) AS records, sum(fetch_time_ns // 1000000)::BIGINT AS fetch_ms
        FROM log WHERE starts_with(domain, 'u1') GROUP BY domain"""
ORACLE["stats_ticks"] = f"""WITH {_TICKS},
        busy AS (
          SELECT crawl, epoch_us(ts) // 21600000000 AS tick, count(*) AS pages, sum(in_flight) AS in_flight,
            arg_max(active_workers, ts) AS active_workers, arg_max(queue_length, ts) AS queue_length
          FROM ticks GROUP BY 1, 2),
        spans AS (
          SELECT *, sum(pages) OVER w AS all_pages, sum(in_flight) OVER w AS all_in_flight,
            coalesce(lead(tick) OVER w, tick + 1) AS next FROM busy WINDOW w AS (PARTITION BY crawl ORDER BY tick)),
        every AS (SELECT *, unnest(range(tick, next)) AS place FROM spans)
        SELECT crawl, place AS tick, all_pages::BIGINT AS pages, all_in_flight::BIGINT AS in_flight, active_workers, queue_length,
          place > tick AS idle FROM every"""
