"""Queries of the general data problems 1, 3, 4, 5 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.operators.drift import Drift
from terazi.operators.faults import find_faults
from terazi.operators.grid import missing_days, to_grid
from terazi.operators.rolling import trailing
from terazi.operators.snapshots import snapshot_changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_grid(table(spark, sf_dir, "general"), table(spark, sf_dir, "holidays"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_days(p1_grid(spark, sf_dir))


def p1_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without its values: readings of each day and the mark of missing ones."""
    return p1_grid(spark, sf_dir).select("fonkodu", "gun", "okuma", "eksik", F.col("deger").isNotNull().alias("degerli"))


def p3_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing(table(spark, sf_dir, "general"))


def drift(spark: SparkSession, sf_dir: str) -> Drift:
    return Drift(table(spark, sf_dir, "allocation_raw"), [table(spark, sf_dir, f"allocation_h{k}") for k in (1, 2, 3, 4)])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(spark, sf_dir).report()


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(spark, sf_dir).table()


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(spark, sf_dir).fields


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "fund_snapshots"), ("fonunvan", "kisisayisi"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "fund_snapshots")).select("fonkodu", "tarih", "change")


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_faults(table(spark, sf_dir, "general"))


def p7_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stuck and impossible values."""
    return p7_faults(spark, sf_dir).filter("kind <> 'spike'").select("kayit_no", "field", "kind")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_faults(spark, sf_dir).select("kayit_no", "field")


DATA_QUERIES = {f.__name__: f for f in (p1_grid, p1_days, p1_found, p3_trailing, p4_fields, p4_found, p4_table, p5_changes, p5_found, p7_faults, p7_fixed, p7_found)}

#: Characters taken as blanks around codes and titles.
BLANK = "' ' || chr(9) || chr(13) || chr(10) || chr(160)"
READINGS = f"""
all_rows AS (SELECT upper(trim(fonkodu, {BLANK})) AS fund, tarih, fiyat, tedpaysayisi, portfoybuyukluk, kayit_no,
    row_number() OVER (PARTITION BY upper(trim(fonkodu, {BLANK})), tarih ORDER BY yukleme DESC NULLS LAST, kayit_no DESC NULLS LAST) AS rn
  FROM general WHERE trim(fonkodu, {BLANK}) <> '' AND tarih IS NOT NULL),
readings AS (SELECT * FROM all_rows WHERE rn = 1 AND NOT coalesce(fiyat = 0 AND tedpaysayisi = 0 AND portfoybuyukluk = 0, false))"""

P1_SQL = f"""WITH {READINGS},
days AS (SELECT DISTINCT fund, CAST(tarih AS DATE) AS d FROM readings),
spans AS (SELECT fund, min(d) AS a, max(d) AS b FROM days GROUP BY fund),
grid AS (SELECT fund, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM spans)
SELECT g.fund AS fonkodu, strftime(g.d, '%Y-%m-%d') AS gun FROM grid g
WHERE isodow(g.d) <= 5 AND g.d NOT IN (SELECT CAST(tatil AS DATE) FROM holidays WHERE tatil IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM days x WHERE x.fund = g.fund AND x.d = g.d)"""

P3_SQL = f"""WITH {READINGS},
daily AS (SELECT fund, CAST(tarih AS DATE) AS d, arg_max(struct_pack(v := CASE WHEN isfinite(portfoybuyukluk) THEN portfoybuyukluk END), tarih).v AS v FROM readings GROUP BY 1, 2),
spans AS (SELECT fund, min(d) AS a, max(d) AS b FROM daily GROUP BY fund),
grid AS (SELECT fund, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM spans),
cal AS (SELECT g.fund, g.d, y.v, CAST(y.v AS DECIMAL(28,2)) AS m FROM grid g LEFT JOIN daily y ON y.fund = g.fund AND y.d = g.d),
w AS (SELECT fund, d, v,
  CAST(coalesce(sum(m) OVER w7, 0) AS DOUBLE) AS t7, count(*) OVER w7 AS n7, count(m) OVER w7 AS k7,
  CAST(coalesce(sum(m) OVER w30, 0) AS DOUBLE) AS t30, count(*) OVER w30 AS n30, count(m) OVER w30 AS k30
  FROM cal WINDOW w7 AS (PARTITION BY fund ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY fund ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT fund AS fonkodu, d AS gun, v AS deger, t7 AS toplam_7, t7 / n7 AS ortalama_7, k7 AS okuma_7, t7 / nullif(k7, 0) AS okuma_ort_7,
  t30 AS toplam_30, t30 / n30 AS ortalama_30, k30 AS okuma_30, t30 / nullif(k30, 0) AS okuma_ort_30 FROM w"""

P1_DAYS = f"""WITH {READINGS},
days AS (SELECT fund, CAST(tarih AS DATE) AS d, count(*) AS n FROM readings GROUP BY 1, 2),
spans AS (SELECT fund, min(d) AS a, max(d) AS b, sum(n) AS n FROM days GROUP BY fund),
valued AS (SELECT DISTINCT fund FROM readings WHERE isfinite(fiyat) AND fiyat > 0),
grid AS (SELECT fund, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM spans)
SELECT g.fund AS fonkodu, strftime(g.d, '%Y-%m-%d') AS gun, coalesce(x.n, 0) AS okuma, x.n IS NULL AS eksik, g.fund IN (SELECT fund FROM valued) AS degerli FROM grid g LEFT JOIN days x ON x.fund = g.fund AND x.d = g.d
WHERE isodow(g.d) <= 5 AND g.d NOT IN (SELECT CAST(tatil AS DATE) FROM holidays WHERE tatil IS NOT NULL)"""

RAW_CELLS = f"""lines AS (SELECT DISTINCT feed, file_seq, payload FROM allocation_raw WHERE feed IS NOT NULL AND file_seq IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
keyed AS (SELECT feed, file_seq, payload, upper(trim(json_extract_string(payload, '$.fonKodu'), {BLANK})) AS fund, try_cast(json_extract_string(payload, '$.tarih') AS DATE) AS day, unnest(json_keys(payload)) AS field FROM lines),
cells AS (SELECT feed, file_seq, nullif(fund, '') AS fund, day, field, json_type(payload, '$."' || field || '"') AS type, json_extract_string(payload, '$."' || field || '"') AS text FROM keyed WHERE lower(field) NOT IN ('fonkodu', 'tarih', 'fonunvan'))"""
P4_FIELDS = f"""WITH {RAW_CELLS},
h AS (SELECT 'TABLE' AS feed, CAST(right(table_name, 1) AS INTEGER) AS file_seq, column_name AS field, CASE WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'number' END AS type FROM information_schema.columns
  WHERE table_name IN ('allocation_h1', 'allocation_h2', 'allocation_h3', 'allocation_h4') AND lower(column_name) NOT IN ('fonkodu', 'tarih', 'fonunvan'))
SELECT feed, CAST(file_seq AS INTEGER) AS file_seq, field, CASE WHEN t > n THEN 'text' WHEN n > 0 THEN 'number' END AS type FROM (
  SELECT feed, file_seq, field, count(*) FILTER (type = 'VARCHAR') AS t, count(*) FILTER (type IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')) AS n FROM cells GROUP BY ALL)
UNION ALL SELECT * FROM h"""

#: A number written as text: without blanks and percent signs; of comma and point the last one parts the decimals.
BARE = "translate(text, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || '%', '')"
WEIGHT = f"""try_cast(CASE WHEN contains({BARE}, ',') AND contains({BARE}, '.') THEN CASE WHEN strpos(reverse({BARE}), ',') < strpos(reverse({BARE}), '.') THEN replace(replace({BARE}, '.', ''), ',', '.') ELSE replace({BARE}, ',', '') END ELSE replace({BARE}, ',', '.') END AS DOUBLE)"""
TABLE_CELLS = " UNION ALL ".join(
    f"SELECT 'TABLE' AS feed, {k} AS file_seq, nullif(upper(trim(fonkodu, {BLANK})), '') AS fund, CAST(tarih AS DATE) AS day, field, text FROM (SELECT fonkodu, tarih, COLUMNS(* EXCLUDE (fonkodu, tarih, fonunvan))::VARCHAR FROM (SELECT DISTINCT * FROM allocation_h{k})) UNPIVOT INCLUDE NULLS (text FOR field IN (COLUMNS(* EXCLUDE (fonkodu, tarih))))"
    for k in (1, 2, 3, 4)
)
P4_WITH = f"""{P4_FIELDS.replace('SELECT feed, CAST(file_seq AS INTEGER) AS file_seq, field, CASE', ', flds AS (SELECT feed, CAST(file_seq AS INTEGER) AS file_seq, field, CASE', 1)}),
every AS (SELECT feed, CAST(file_seq AS INTEGER) AS file_seq, fund, day, field, CASE WHEN type IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN {WEIGHT} END AS weight FROM cells UNION ALL SELECT feed, file_seq, fund, day, field, {WEIGHT} FROM ({TABLE_CELLS})),
files AS (SELECT DISTINCT feed, file_seq FROM flds),
steps AS (SELECT feed, file_seq, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS prior FROM files QUALIFY prior IS NOT NULL),
gone AS (SELECT s.feed, s.file_seq, s.prior, f.field FROM steps s JOIN flds f ON f.feed = s.feed AND f.file_seq = s.prior WHERE NOT EXISTS (SELECT 1 FROM flds x WHERE x.feed = s.feed AND x.file_seq = s.file_seq AND x.field = f.field)),
come AS (SELECT s.feed, s.file_seq, f.field FROM steps s JOIN flds f ON f.feed = s.feed AND f.file_seq = s.file_seq WHERE NOT EXISTS (SELECT 1 FROM flds x WHERE x.feed = s.feed AND x.file_seq = s.prior AND x.field = f.field)),
means AS (SELECT feed, file_seq, fund, field, avg(weight) AS w FROM every WHERE fund IS NOT NULL AND weight IS NOT NULL AND isfinite(weight) GROUP BY ALL),
pairs AS (SELECT g.feed, g.file_seq, g.field, c.field AS new_field, count(*) AS sources, count(*) FILTER (abs(a.w - b.w) <= greatest(0.05, 0.2 * greatest(abs(a.w), abs(b.w)))) AS agree
  FROM gone g JOIN come c ON c.feed = g.feed AND c.file_seq = g.file_seq JOIN means a ON a.feed = g.feed AND a.file_seq = g.prior AND a.field = g.field JOIN means b ON b.feed = c.feed AND b.file_seq = c.file_seq AND b.field = c.field AND b.fund = a.fund
  WHERE a.w <> 0 OR b.w <> 0 GROUP BY ALL),
renamed AS (SELECT *, agree / sources AS share FROM pairs WHERE sources >= 3 AND agree / sources > 0.5
  QUALIFY row_number() OVER (PARTITION BY feed, file_seq, field ORDER BY agree / sources DESC, new_field) = 1 AND row_number() OVER (PARTITION BY feed, file_seq, new_field ORDER BY agree / sources DESC, field) = 1)"""
P4_FOUND = f"""{P4_WITH}
SELECT feed, file_seq, 'renamed' AS change, field, new_field FROM renamed
UNION ALL SELECT feed, file_seq, 'removed', field, '' FROM gone ANTI JOIN renamed USING (feed, file_seq, field)
UNION ALL SELECT feed, file_seq, 'added', field, '' FROM come ANTI JOIN (SELECT feed, file_seq, new_field AS field FROM renamed) USING (feed, file_seq, field)
UNION ALL SELECT s.feed, s.file_seq, 'retyped', b.field, '' FROM steps s JOIN flds a ON a.feed = s.feed AND a.file_seq = s.prior JOIN flds b ON b.feed = s.feed AND b.file_seq = s.file_seq AND b.field = a.field WHERE a.type <> b.type"""
P4_TABLE = f"""{P4_WITH.replace('WITH lines', 'WITH RECURSIVE lines', 1)},
walk AS (SELECT feed, file_seq, field, file_seq AS seen, field AS canonical FROM flds
  UNION ALL SELECT w.feed, w.file_seq, w.field, r.file_seq, r.new_field FROM walk w JOIN renamed r ON r.feed = w.feed AND r.field = w.canonical AND r.file_seq > w.seen
    AND NOT EXISTS (SELECT 1 FROM renamed e WHERE e.feed = r.feed AND e.field = r.field AND e.file_seq > w.seen AND e.file_seq < r.file_seq)),
ends AS (SELECT feed, file_seq, field, arg_max(canonical, seen) AS canonical FROM walk GROUP BY ALL)
SELECT feed, file_seq, fund AS fonkodu, day AS tarih, canonical AS field, field AS source_field, CASE WHEN isfinite(weight) THEN weight END AS weight FROM every JOIN ends USING (feed, file_seq, field)"""

P7_FIXED = f"""WITH {READINGS},
vals AS ({' UNION ALL '.join(f"SELECT fund, tarih, kayit_no, '{c}' AS field, {c} AS v FROM readings WHERE isfinite({c})" for c in ('fiyat', 'tedpaysayisi', 'portfoybuyukluk'))}),
seqs AS (SELECT *, lag(v) OVER w AS before, row_number() OVER w AS i FROM vals WHERE v > 0 WINDOW w AS (PARTITION BY fund, field ORDER BY tarih)),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> v THEN 1 ELSE 0 END) OVER (PARTITION BY fund, field ORDER BY i) AS run FROM seqs),
sized AS (SELECT *, count(*) OVER (PARTITION BY fund, field, run) AS size, row_number() OVER (PARTITION BY fund, field, run ORDER BY i) AS pos FROM runs),
shares AS (SELECT fund, field, count(*) FILTER (before IS NOT NULL) AS steps, count(*) FILTER (before <> v) AS moves, count(*) FILTER (before = v AND size >= 6) AS inside FROM sized GROUP BY ALL)
SELECT kayit_no, field, 'impossible' AS kind FROM vals WHERE v <= 0
UNION ALL SELECT kayit_no, field, 'stuck' FROM sized JOIN shares USING (fund, field) WHERE size >= 6 AND pos > 1 AND moves >= 0.5 * steps AND moves >= 0.9 * (steps - inside)"""

P5_WITH = f"""WITH s AS (SELECT CAST(tarih AS DATE) AS d, coalesce(teslim_no, -1) AS n, upper(trim(fonkodu, {BLANK})) AS k, regexp_replace(trim(fonunvan, {BLANK}), '[ \\t\\r\\n\\x{{00A0}}]+', ' ', 'g') AS title, CAST(kisisayisi AS VARCHAR) AS holders FROM fund_snapshots WHERE tarih IS NOT NULL),
days AS (SELECT d, max(n) AS n, row_number() OVER (ORDER BY d) AS i FROM s GROUP BY d),
x AS (SELECT s.k, days.i, min(s.title) AS title, min(struct_pack(a := coalesce(s.title, ''), c := s.title IS NOT NULL, b := coalesce(s.holders, ''), t := s.title, h := s.holders)) AS both FROM s JOIN days ON s.d = days.d AND s.n = days.n WHERE s.k <> '' GROUP BY ALL)"""
P5_JOIN = "FROM x a FULL JOIN x b ON b.k = a.k AND b.i = a.i + 1"
KIND = "CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END"
P5_CHANGES = " UNION ALL ".join(f"SELECT coalesce(a.k, b.k) AS k, coalesce(b.i, a.i + 1) AS i, {KIND} AS change, '{f}' AS field, a.both.{c} AS old_value, b.both.{c} AS new_value {P5_JOIN} WHERE a.k IS NULL OR b.k IS NULL OR a.both.{c} IS DISTINCT FROM b.both.{c}" for f, c in (("fonunvan", "t"), ("kisisayisi", "h")))

DATA_SQL = {
    "p1_found": P1_SQL,
    "p1_days": P1_DAYS,
    "p3_trailing": P3_SQL,
    "p4_fields": P4_FIELDS,
    "p4_found": P4_FOUND,
    "p4_table": P4_TABLE,
    "p5_changes": f"{P5_WITH}, c AS ({P5_CHANGES}) SELECT c.k AS fonkodu, strftime(days.d, '%Y-%m-%d') AS tarih, change, field, old_value, new_value FROM c JOIN days ON days.i = c.i WHERE c.i > 1",
    "p5_found": f"{P5_WITH}, c AS (SELECT coalesce(a.k, b.k) AS k, coalesce(b.i, a.i + 1) AS i, {KIND} AS change {P5_JOIN} WHERE a.k IS NULL OR b.k IS NULL OR a.title IS DISTINCT FROM b.title) SELECT c.k AS fonkodu, strftime(days.d, '%Y-%m-%d') AS tarih, change FROM c JOIN days ON days.i = c.i WHERE c.i > 1",
    "p7_fixed": P7_FIXED,
}
