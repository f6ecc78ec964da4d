"""The registered queries in DuckDB's SQL, written apart from the operators."""

from __future__ import annotations

from ..functions import policy as P
from ..sources import stand_in

SALT = "stand-in salt"


def words(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


IMG = stand_in.IMAGES.format(lineitem="lineitem", supplier="supplier")
REVIEW = f"CASE WHEN sop_class_uid IN ({words(P.REVIEW_SOP_CLASSES)}) THEN 'SOP class ' || sop_class_uid WHEN modality IN ({words(P.REVIEW_MODALITIES)}) THEN 'Modality ' || modality WHEN upper(burned_in) = 'YES' THEN 'BurnedInAnnotation=YES' END"
G = "rtrim(rtrim(CAST(CAST({0} AS DECIMAL(12, 4)) AS VARCHAR), '0'), '.')"
FIRST = ", ".join(f"arg_min({c}, path) AS {c}" for c in ("series_number", "description", "modality", "sop_class_uid", "image_type", "slice_mm", "fov_mm", "kernel", "contrast", "frames", "burned_in"))
SHARP = " OR ".join(f"contains(lower(kernel), '{k.lower()}')" for k in P.SHARP_KERNELS)

WITH = f"""
WITH img AS (SELECT *, patient AS study_id, {REVIEW} AS review FROM ({IMG}) i),
ser AS (SELECT study_id, series_uid, count(*) AS n_files, min(path) AS sample, first(phase ORDER BY path) AS phase, {FIRST} FROM img GROUP BY study_id, series_uid),
cls0 AS (SELECT *, list_filter([{words(P.DROP_WORDS)}], lambda w: contains(regexp_replace(lower(description), 'snap\\s*shot\\s*(pulse|segment|burst|freeze)', 'ge_gated_cta', 'g'), w))[1] AS word FROM ser),
cls1 AS (SELECT *, concat_ws('; ',
    CASE WHEN modality <> 'CT' OR sop_class_uid IN ({words(P.REVIEW_SOP_CLASSES)}) OR sop_class_uid LIKE '{P.REPORT_SOP_PREFIX}%' THEN 'not a CT image (' || modality || ')' END,
    CASE WHEN image_type LIKE '%LOCALIZER%' OR image_type LIKE '%SECONDARY%' OR image_type LIKE '%DERIVED%' OR image_type LIKE '%MPR%' THEN 'localiser/derived' END,
    CASE WHEN slice_mm > 0.8 THEN {G.format("slice_mm")} || ' mm slices' END,
    CASE WHEN n_files < 100 AND frames < 100 THEN 'only ' || n_files || ' images' END,
    CASE WHEN fov_mm > 260 THEN 'FOV ' || CAST(fov_mm AS BIGINT) || ' mm (chest recon)' END,
    CASE WHEN {SHARP} THEN 'kernel ' || kernel END,
    CASE WHEN word IS NOT NULL THEN 'description ''' || word || '''' END) AS dropped,
  'coronary recon: ' || {G.format("slice_mm")} || ' mm, FOV ' || CAST(fov_mm AS BIGINT) || ', ' || kernel AS label FROM cls0),
cls AS (SELECT * EXCLUDE (dropped, label, word),
    CASE WHEN dropped <> '' THEN 'drop' WHEN contrast = '' AND phase IS NULL AND NOT regexp_matches(lower(description), 'cta|coro|angio') THEN 'maybe' ELSE 'keep' END AS verdict,
    CASE WHEN dropped <> '' THEN dropped WHEN contrast = '' AND phase IS NULL AND NOT regexp_matches(lower(description), 'cta|coro|angio') THEN label || ' - no contrast agent / cardiac phase in header' ELSE label END AS reason FROM cls1),
lr AS (SELECT *, fits AND count(*) FILTER (fits) OVER (PARTITION BY study_id) = 1 AS last_resort FROM (SELECT *, modality = 'CT' AND image_type LIKE '%PRIMARY%' AND image_type NOT LIKE '%LOCALIZER%' AND image_type NOT LIKE '%SECONDARY%' AND slice_mm <= 0.8 AND (n_files >= 100 OR frames >= 100) AS fits FROM cls) t)
"""


def decisions(picks: str = "", selection: str = "") -> str:
    """CTEs up to `dec`, the decided series; picks and selection are queries."""
    picks = picks or "SELECT NULL::VARCHAR AS study_id, NULL::VARCHAR AS series_uid, NULL::VARCHAR AS series_description WHERE false"
    selection = selection or "SELECT NULL::VARCHAR AS study_id, NULL::VARCHAR AS series_uid WHERE false"
    return f"""{WITH}, pk AS ({picks}), sel AS ({selection}),
pm AS (SELECT p.study_id, p.pick, s.series_uid, 'uid' AS match FROM (SELECT *, row_number() OVER () AS pick FROM pk) p JOIN cls s ON p.study_id = s.study_id AND p.series_uid <> '' AND p.series_uid = s.series_uid),
pd AS (SELECT p.study_id, s.series_uid FROM pk p JOIN cls s ON p.study_id = s.study_id AND p.series_description <> '' AND lower(trim(regexp_replace(p.series_description, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(s.description, '\\s+', ' ', 'g')))
  WHERE NOT EXISTS (SELECT 1 FROM cls c WHERE c.study_id = p.study_id AND c.series_uid = p.series_uid AND p.series_uid <> '')),
got AS (SELECT DISTINCT study_id, series_uid FROM (SELECT study_id, series_uid FROM pm UNION ALL SELECT study_id, series_uid FROM pd) u),
flag AS (SELECT l.*, EXISTS (SELECT 1 FROM sel WHERE sel.study_id = l.study_id) AS selected, EXISTS (SELECT 1 FROM sel WHERE sel.study_id = l.study_id AND sel.series_uid = l.series_uid) AS ticked,
  EXISTS (SELECT 1 FROM got WHERE got.study_id = l.study_id AND got.series_uid = l.series_uid) AS picked FROM lr l),
lev AS (SELECT *, picked AND coalesce(slice_mm, 0) <= 0.8 AS thin, bool_or(picked AND coalesce(slice_mm, 0) <= 0.8) OVER w AS any_thin, bool_or(verdict = 'keep') OVER w AS any_keep, bool_or(verdict = 'maybe') OVER w AS any_maybe FROM flag WINDOW w AS (PARTITION BY study_id)),
dec AS (SELECT study_id, series_uid, series_number, n_files AS images, CASE WHEN (CASE WHEN selected THEN ticked WHEN any_thin THEN thin WHEN any_keep THEN verdict = 'keep' WHEN any_maybe THEN verdict = 'maybe' ELSE last_resort END) THEN 'keep' ELSE 'drop' END AS decision,
  CASE WHEN selected THEN CASE WHEN ticked THEN 'ticked in the viewer' ELSE 'not ticked in the viewer' END
    WHEN thin THEN 'analysed series (FAI pick)'
    WHEN picked AND NOT any_thin THEN reason || ' [FAI pick but ' || {G.format("slice_mm")} || ' mm]'
    WHEN NOT any_thin AND NOT any_keep AND any_maybe AND verdict = 'maybe' THEN reason || ' [kept as fallback - CHECK]'
    WHEN NOT any_thin AND NOT any_keep AND NOT any_maybe AND last_resort THEN reason || ' [only thin primary series in export] [kept as fallback - CHECK]'
    ELSE reason END AS reason FROM lev)
"""


PICKS = """SELECT 'P' || s_suppkey AS study_id, CASE s_suppkey % 3 WHEN 0 THEN '1.2.3.40.' || s_suppkey || '.3' WHEN 1 THEN '' ELSE 'unknown' END AS series_uid,
  CASE s_suppkey % 3 WHEN 1 THEN ' Coro   ANGIO fine' WHEN 2 THEN 'acquisition 9' ELSE '' END AS series_description FROM supplier"""
SELECTION = "SELECT 'P' || s_suppkey AS study_id, '1.2.3.40.' || s_suppkey || '.5' AS series_uid FROM supplier WHERE s_acctbal < 0"
TEXT = "lower(coalesce(description, '') || ' ' || coalesce(kernel, ''))"

ELEMENTS = f"SELECT *, 'CV' || o_custkey AS study_id, regexp_extract(path, '^([^\\[.]+)', 1) AS top, regexp_extract(path, '([^.]+)$', 1) AS keyword, contains(path, '].') AS nested FROM ({stand_in.elements_sql().format(orders='orders', customer='customer')}) x"
HASHED = f"'2.25.' || CAST(('0x' || substr(sha256('{SALT}|' || {{0}}), 1, 32))::UHUGEINT AS VARCHAR)"
DAYS = f"CAST(('0x' || substr(sha256('{SALT}|dateshift|' || study_id), 1, 8))::UBIGINT % 3650 + 1 AS INTEGER)"
PRIVATE = "(is_private OR contains(path, '(0b05,1002)'))"


def policy_sql(kept: tuple = (), shift: bool = False, age: bool = False, method: str = f"{P.TOOL} {P.VERSION} full blind") -> str:
    """CTE `fin`: the de-identified elements as instance_id and line."""
    remove, clear = [k for k in P.REMOVE if k not in kept], [k for k in P.CLEAR if k not in kept]
    da = f"strftime(strptime(value, '%Y%m%d') - to_days({DAYS}), '%Y%m%d')" if shift else f"'{P.DUMMY_DATE}'"
    dt = f"strftime(strptime(substr(value, 1, 8), '%Y%m%d') - to_days({DAYS}), '%Y%m%d') || substr(value, 9)" if shift else f"'{P.DUMMY_DATETIME}'"
    tm = "value" if shift else f"'{P.DUMMY_TIME}'"
    years = "(year(seen) - year(born) - CASE WHEN strftime(seen, '%m%d') < strftime(born, '%m%d') THEN 1 ELSE 0 END)"
    bucket = f"""UNION ALL SELECT instance_id, 'data:PatientAge=' || lpad(CAST(least(y - y % 5, 120) AS VARCHAR), 3, '0') || 'Y' FROM (SELECT instance_id, CASE WHEN age = '030M' THEN 2 WHEN age = '058Y' THEN 58 ELSE {years} END AS y
        FROM (SELECT instance_id, max(value) FILTER (path = 'PatientAge') AS age, strptime(max(value) FILTER (path = 'PatientBirthDate'), '%Y%m%d') AS born, strptime(max(value) FILTER (path = 'StudyDate'), '%Y%m%d') AS seen FROM e GROUP BY instance_id) a) b WHERE y >= 0""" if age else ""
    return f"""e AS ({ELEMENTS}),
act AS (SELECT *, CASE WHEN {PRIVATE} THEN 'private' WHEN grp = 'data' AND top IN ({words(remove)}) THEN 'removed' WHEN grp = 'data' AND top IN ({words(P.VENDOR_HINTS)}) THEN 'vendor'
    WHEN grp = 'data' AND top IN ({words(clear)}) THEN 'cleared' WHEN grp = 'meta' AND keyword IN ({words(P.META_FORBIDDEN)}) THEN 'meta' END AS action FROM e),
lft AS (SELECT * FROM act WHERE action IS NULL OR (action = 'cleared' AND NOT nested AND vr NOT IN ({words(P.UNBLANKABLE)}))),
new AS (SELECT *, CASE WHEN action = 'cleared' THEN CASE vr WHEN 'SQ' THEN '0' ELSE '' END
    WHEN vr = 'DA' AND value <> '' THEN {da} WHEN vr = 'DT' AND value <> '' THEN {dt} WHEN vr = 'TM' AND value <> '' THEN {tm}
    WHEN vr = 'UI' AND keyword NOT IN ({words(P.UID_KEEP)}) AND value <> '' THEN array_to_string(list_transform(string_split(value, '\\'), lambda v: CASE WHEN v = '' OR starts_with(v, '{P.STANDARD_UID_PREFIX}') THEN v ELSE {HASHED.format('v')} END), '\\')
    WHEN path = 'ImageType' THEN array_to_string(string_split(value, '\\')[1:3], '\\') ELSE value END AS after FROM lft WHERE path NOT IN ('PatientName', 'PatientID', 'MediaStorageSOPInstanceUID')),
obj AS (SELECT instance_id, any_value(study_id) AS study_id, max(value) FILTER (path = 'SOPInstanceUID') AS uid, max(value) FILTER (path = 'SOPClassUID') AS class FROM e GROUP BY instance_id),
fin AS (SELECT instance_id, grp || ':' || path || '=' || after AS line FROM new
  UNION ALL SELECT instance_id, unnest(['data:PatientName=' || study_id, 'data:PatientID=' || study_id, 'data:PatientIdentityRemoved=YES', 'data:DeidentificationMethod={method}', 'data:BurnedInAnnotation=NO', 'meta:MediaStorageSOPInstanceUID=' || {HASHED.format('uid')},
    'meta:MediaStorageSOPClassUID=' || class, 'meta:ImplementationClassUID={P.IMPLEMENTATION_UID}', 'meta:ImplementationVersionName=VEIL_{P.VERSION.replace('.', '')}']) FROM obj
  {bucket})"""


DIGEST = "SELECT instance_id, count(*) AS attributes, sha256(string_agg(line, ';' ORDER BY line)) AS digest FROM fin GROUP BY instance_id"
RULES = f"""SELECT instance_id, kind, detail FROM e, unnest([
  CASE WHEN grp = 'data' AND is_private THEN {{'kind': 'private tag present', 'detail': path}} END,
  CASE WHEN grp = 'data' AND NOT is_private AND vr = 'DA' AND value NOT IN ('', '{P.DUMMY_DATE}') THEN {{'kind': 'real date', 'detail': keyword || '=' || value}} END,
  CASE WHEN grp = 'data' AND NOT is_private AND vr = 'DT' AND value <> '' AND NOT starts_with(value, '{P.DUMMY_DATE}') THEN {{'kind': 'real datetime', 'detail': keyword || '=' || value}} END,
  CASE WHEN grp = 'data' AND NOT is_private AND vr = 'TM' AND value NOT IN ('', '{P.DUMMY_TIME}') THEN {{'kind': 'real time', 'detail': keyword || '=' || value}} END,
  CASE WHEN grp = 'data' AND NOT is_private AND vr = 'UI' AND value <> '' AND keyword NOT IN ({words(P.UID_KEEP)}) AND len(list_filter(string_split(value, '\\'), lambda v: v <> '' AND NOT starts_with(v, '2.25.') AND NOT starts_with(v, '{P.STANDARD_UID_PREFIX}'))) > 0 THEN {{'kind': 'original UID', 'detail': keyword || '=' || value}} END,
  CASE WHEN grp = 'meta' AND keyword IN ({words(P.META_FORBIDDEN)}) THEN {{'kind': 'file meta carries PACS identity', 'detail': keyword}} END,
  CASE WHEN grp = 'data' AND path IN ('PatientBirthDate', 'OtherPatientIDs', 'DeviceSerialNumber', 'SoftwareVersions', 'PatientSex', 'PatientAge') THEN {{'kind': 'attribute should be absent', 'detail': keyword}} END,
  CASE WHEN grp = 'data' AND value <> '' AND path IN ('StationName', 'SeriesDescription', 'ProtocolName', 'AccessionNumber', 'InstitutionName', 'Manufacturer', 'ManufacturerModelName', 'StudyDescription') THEN {{'kind': 'attribute should be empty', 'detail': keyword || '=' || value}} END,
  CASE WHEN grp = 'data' AND value <> '' AND path IN ('ConvolutionKernel', 'ScanOptions', 'FilterType') THEN {{'kind': 'vendor hint present', 'detail': keyword || '=' || value}} END,
  CASE WHEN grp = 'data' AND value <> '' AND path IN ({words(P.PN_KEYWORDS)}) THEN {{'kind': 'person name present', 'detail': keyword || '=' || value}} END]) u(f), (SELECT f.kind AS kind, f.detail AS detail) WHERE f IS NOT NULL"""
RULES = RULES.replace("FROM e, unnest([", "FROM (SELECT instance_id, f.kind AS kind, f.detail AS detail FROM (SELECT instance_id, unnest([").replace("]) u(f), (SELECT f.kind AS kind, f.detail AS detail) WHERE f IS NOT NULL", "]) AS f FROM e) r WHERE f IS NOT NULL) q")
OBJECT_RULES = """SELECT instance_id, 'PatientName not as profile dictates' AS kind, name || ' / expected ' || id AS detail FROM (SELECT instance_id, max(value) FILTER (path = 'PatientName') AS name, max(value) FILTER (path = 'PatientID') AS id FROM e GROUP BY instance_id) h WHERE name <> id
  UNION ALL SELECT DISTINCT instance_id, 'PatientIdentityRemoved not YES', '' FROM e"""
SWEPT = f"SELECT instance_id, keyword, upper(value) AS text FROM e WHERE grp = 'data' AND NOT is_private AND vr IN ({words(P.TEXT_VRS)}) AND value <> ''"
RUNS = "SELECT 'U' || user_id AS study_id, event_type AS series, event_id AS run, CASE WHEN value > 50 THEN 'keep' ELSE 'drop' END AS decision, CASE WHEN event_id % 5 = 0 THEN 'x [kept as fallback - CHECK]' ELSE 'rule' END AS reason FROM events"
HISTORY = f"SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY study_id, series ORDER BY run DESC) AS nth FROM ({RUNS}) r) t WHERE nth = 1"
KIND = f"""{WITH}, rv AS (SELECT *, {REVIEW} AS review, lower(trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS kind FROM cls),
k0 AS (SELECT modality, kind, round(slice_mm, 2) AS slice_mm, count(DISTINCT study_id) AS n_units, CAST(sum(n_files) AS BIGINT) AS n_images, count(DISTINCT study_id) FILTER (verdict = 'keep') AS coronary, count(DISTINCT study_id) FILTER (verdict = 'maybe') AS maybe,
  min(review) AS review, min(reason) AS reason, arg_max(sample, n_files * 1000000 + rank) AS sample FROM (SELECT *, row_number() OVER (ORDER BY sample) AS rank FROM rv) r GROUP BY 1, 2, 3),
k1 AS (SELECT *, CAST(round_even(n_images / n_units, 0) AS BIGINT) AS per FROM k0),
k AS (SELECT *, CASE WHEN coronary > 0 AND coronary = n_units THEN 'coronary CT' WHEN coronary > 0 THEN 'coronary CT in ' || coronary || ' of ' || n_units WHEN review IS NOT NULL AND modality IN ('SR', 'DOC', 'PR', 'KO') THEN 'a report or note: held back for a look'
  WHEN review IS NOT NULL THEN 'held back for a look: may carry burned-in text' WHEN maybe > 0 THEN 'thin CT, no contrast noted in the header' WHEN contains(reason, 'localiser') THEN 'scout or reformat' || CASE WHEN per > 1 THEN ', ' || format('{{:,}}', per) || ' images each' ELSE '' END
  WHEN per > 1 THEN format('{{:,}}', per) || ' images each' ELSE 'a single image' END AS note FROM k1)"""
GIVEN = "SELECT 'P' || s_suppkey AS match_key, 'ANON-' || CASE WHEN s_suppkey > 999 THEN substr(CAST(s_suppkey AS VARCHAR), 1, 3) ELSE lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END AS new_id, s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000"
STATE = "SELECT 'CV' || c_custkey AS study_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'complete' ELSE 'partial' END AS state FROM customer"
FACTS = """WITH facts AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 3 + 1 END AS complete, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_suppkey % 4 + 1 END AS partial, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 9 + 1 END AS review_files, s_suppkey % 10 AS last_run_at,
  s_suppkey % 7 AS verified_at, CASE s_suppkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' END AS status, s_suppkey % 6 % 2 AS linkage_files, s_suppkey % 8 % 3 AS other_logs, s_suppkey % 11 > 0 AS attested FROM supplier)"""
UNITS = f"""{WITH}, own AS (SELECT patient, study, series_uid, CASE WHEN pid % 2 = 0 THEN patient || '/' || study || '/' || path ELSE path END AS path FROM (SELECT *, substr(study_date, 1, 4) AS study FROM img) i),
fo AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM own),
cf AS (SELECT patient, study, count(*) AS files, count(DISTINCT series_uid) AS series, min(string_split(folder, '/')) AS lo, max(string_split(folder, '/')) AS hi FROM fo GROUP BY patient, study),
st AS (SELECT patient, study, files, series, lo[1:len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda n: lo[1:n] = hi[1:n]))] AS steps FROM cf),
nx AS (SELECT *, lead(steps) OVER (PARTITION BY patient ORDER BY steps) AS after FROM st),
kd AS (SELECT patient, bool_or(coalesce(after[1:len(steps)] = steps, false)) AS nests, count(*) AS studies FROM nx GROUP BY patient),
wh AS (SELECT patient, count(*) AS files, count(DISTINCT series_uid) AS series, min(string_split(folder, '/')) AS lo, max(string_split(folder, '/')) AS hi FROM fo WHERE patient IN (SELECT patient FROM kd WHERE nests OR studies = 1) GROUP BY patient),
un AS (SELECT st.patient, st.study, array_to_string(steps, '/') AS folder, files, series FROM st JOIN kd ON st.patient = kd.patient WHERE studies > 1 AND NOT nests
  UNION ALL SELECT patient, NULL, array_to_string(lo[1:len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda n: lo[1:n] = hi[1:n]))], '/'), files, series FROM wh)"""
PIX = "SELECT vec_id, label, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 100)) AS p FROM embeddings"
NAMED = """SELECT study_id, path, CASE WHEN review IS NOT NULL THEN '_review/' || study_id ELSE study_id || '/S' || lpad(CAST(series_number AS VARCHAR), 3, '0') END AS folder,
    CASE WHEN instance_number <> '' THEN study_id || '_S' || lpad(CAST(series_number AS VARCHAR), 3, '0') || '_I' || lpad(instance_number, CAST(greatest(5, length(instance_number)) AS INTEGER), '0') || '.dcm'
      ELSE study_id || '_' || lpad(CAST(counter AS VARCHAR), CAST(greatest(6, length(CAST(counter AS VARCHAR))) AS INTEGER), '0') || '.dcm' END AS name, counter FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY path) AS counter FROM img) i"""
MAPPED = "SELECT 'H' || CAST(1000000 + c_custkey AS VARCHAR) AS key, 'CV' || c_custkey AS study_id, c_custkey FROM customer WHERE c_acctbal > 0"
DEC = "study_id, series_uid, series_number, images, decision, reason"

SQL = {
    "series_decisions": f"{decisions()} SELECT {DEC} FROM dec",
    "series_picks_cascade": f"{decisions(PICKS)} SELECT {DEC} FROM dec",
    "series_selection": f"{decisions('', SELECTION)} SELECT {DEC} FROM dec",
    "pick_matches": f"{decisions(PICKS)} SELECT match, count(*) AS picks FROM (SELECT p.study_id, CASE WHEN EXISTS (SELECT 1 FROM cls c WHERE c.study_id = p.study_id AND c.series_uid = p.series_uid AND p.series_uid <> '') THEN 'uid' WHEN EXISTS (SELECT 1 FROM pd WHERE pd.study_id = p.study_id) THEN 'desc' ELSE 'unmatched' END AS match FROM pk p) t GROUP BY match",
    "series_survey": f"""{WITH}, sv AS (SELECT *, list_filter([{words(P.SURVEY_DROP_WORDS)}], lambda w: contains({TEXT}, w)) AS d, list_filter([{words(P.SURVEY_KEEP_WORDS)}], lambda w: contains({TEXT}, w)) AS k FROM ser),
      j AS (SELECT *, CASE WHEN modality <> 'CT' OR {' OR '.join(f"starts_with(sop_class_uid, '{x}')" for x in P.NOT_CT_PREFIXES)} THEN 'drop|not a CT image object (' || modality || ')'
        WHEN image_type LIKE '%LOCALIZER%' OR {' OR '.join(f"contains({TEXT}, '{x}')" for x in P.SURVEY_SCOUTS)} THEN 'drop|localiser/topogram'
        WHEN image_type LIKE '%SECONDARY%' OR image_type LIKE '%DERIVED%' OR image_type LIKE '%MPR%' THEN 'drop|derived/secondary image (' || image_type || ')'
        WHEN n_files < 40 AND frames < 40 THEN 'drop|only ' || n_files || ' images' WHEN slice_mm > 1.5 THEN 'drop|slice ' || slice_mm || ' mm' WHEN len(d) > 0 THEN 'drop|description/kernel: ' || array_to_string(d[1:3], ', ')
        WHEN contrast = '' AND len(k) = 0 THEN 'check|no contrast field and no CTA keyword in description' WHEN len(k) = 0 AND description = '' THEN 'check|no series description'
        ELSE 'keep|thin axial CT, ' || n_files || ' images' || CASE WHEN contrast <> '' THEN ', contrast ' || substr(contrast, 1, 20) ELSE '' END || CASE WHEN len(k) > 0 THEN ', ''' || k[1] || '''' ELSE '' END END AS v FROM sv)
      SELECT study_id, series_uid, series_number, modality, n_files AS images, split_part(v, '|', 1) AS decision, CASE WHEN NOT bool_or(v LIKE 'keep|%') OVER (PARTITION BY study_id) AND v LIKE 'check|%' THEN substr(v, strpos(v, '|') + 1) || ' [NO keep candidate in this study]' ELSE substr(v, strpos(v, '|') + 1) END AS reason FROM j""",
    "review_routing": f"{WITH} SELECT study_id, review, count(*) AS files FROM img GROUP BY study_id, review",
    "last_resort_series": f"{WITH} SELECT study_id, series_uid, n_files FROM lr WHERE last_resort",
    "kept_images": f"{decisions()} SELECT img.study_id, count(*) AS files, min(path) AS first_path FROM img JOIN dec ON img.study_id = dec.study_id AND img.series_uid = dec.series_uid WHERE decision = 'keep' GROUP BY img.study_id",
    "thick_audit": f"{WITH} SELECT study_id, string_agg(t, ', ' ORDER BY t) AS thick_series, count(*) AS n FROM (SELECT study_id, 'S' || lpad(CAST(series_number AS VARCHAR), 3, '0') || '=' || {G.format('slice_mm')} || ' mm' AS t FROM cls WHERE slice_mm > 0.8) x GROUP BY study_id",
    "uid_hash": f"SELECT o_orderkey, {HASHED.format("'1.3.12.' || o_custkey || '.' || o_orderkey")} AS uid FROM orders JOIN customer ON o_custkey = c_custkey",
    "date_shift": f"SELECT o_orderkey, da, days, strftime(d - to_days(days), '%Y%m%d') AS shifted, strftime(d - to_days(days), '%Y%m%d') || '154522.12' AS shifted_dt, '19000101' AS fallback FROM (SELECT *, {DAYS} AS days FROM (SELECT o_orderkey, o_orderdate AS d, strftime(o_orderdate, '%Y%m%d') AS da, 'CV' || o_custkey AS study_id FROM orders JOIN customer ON o_custkey = c_custkey) a) b",
    "age_bucket": "SELECT o_orderkey, CAST(CASE WHEN y >= 0 THEN y END AS INTEGER) AS years, CASE WHEN y >= 0 THEN lpad(CAST(least(y - y % 5, 120) AS VARCHAR), 3, '0') || 'Y' END AS bucket FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) - (1930 + o_custkey % 70) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) < (1 + o_custkey % 12) * 100 + 1 + o_custkey % 28 THEN 1 ELSE 0 END WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 58 END AS y FROM orders JOIN customer ON o_custkey = c_custkey) t",
    "tag_policy": f"WITH {policy_sql()} {DIGEST}",
    "tag_policy_profile": f"WITH {policy_sql(('PatientSex',), True, True, P.PROFILES['longitudinal'].method())} {DIGEST}",
    "tag_counters": f"""WITH {policy_sql()} SELECT instance_id, count(*) FILTER (grp = 'data' AND stays AND vr IN ('DA', 'TM', 'DT')) AS dates, count(*) FILTER (grp = 'data' AND stays AND vr = 'UI' AND keyword NOT IN ({words(P.UID_KEEP)})) AS uids,
      count(*) FILTER (action = 'removed' AND NOT nested) AS removed, count(*) FILTER (action = 'cleared' AND NOT nested) AS cleared, count(*) FILTER (action = 'private' AND NOT nested) AS private FROM (SELECT *, action IS NULL OR (action = 'cleared' AND NOT nested AND vr NOT IN ({words(P.UNBLANKABLE)})) AS stays FROM act) t GROUP BY instance_id""",
    "header_diff_summary": f"""WITH {policy_sql()}, b AS (SELECT instance_id, grp || ':' || path AS k, keyword, value FROM e), a AS (SELECT instance_id, split_part(line, '=', 1) AS k, substr(line, strpos(line, '=') + 1) AS value FROM fin)
      SELECT coalesce(b.keyword, split_part(a.k, ':', 2)) AS keyword, count(*) FILTER (a.k IS NULL) AS removed, count(*) FILTER (a.value <> b.value) AS changed, count(*) FILTER (b.k IS NULL) AS added, count(*) FILTER (a.value = b.value) AS kept FROM b FULL JOIN a ON a.instance_id = b.instance_id AND a.k = b.k GROUP BY 1""",
    "id_mapping": f"SELECT study_id, count(*) AS files FROM orders JOIN customer c ON o_custkey = c.c_custkey JOIN ({MAPPED}) m ON m.c_custkey = o_custkey GROUP BY study_id",
    "unmapped_and_missing": f"""SELECT 'H' || CAST(1000000 + o_custkey AS VARCHAR) AS source_key, count(*) AS files_skipped, 'scans on disk but no mapping row' AS note FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal <= 0 GROUP BY 1
      UNION ALL SELECT key, 0, 'mapping row but no scans found on disk' FROM ({MAPPED}) m WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = m.c_custkey)""",
    "manifest_files": f"{WITH} SELECT 'CV' || s_suppkey AS study_id, count(path) AS files FROM supplier LEFT JOIN img ON starts_with(path, 'P' || s_suppkey || '/S' || (1 + s_suppkey % 8) || '/') GROUP BY 1",
    "skipped_files": f"""{WITH} SELECT study_id, count(*) AS files FROM img WHERE path NOT IN (SELECT 'P' || l_suppkey || '/S' || (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) || '/' || l_orderkey || '_' || l_linenumber || '_' || l_partkey FROM lineitem WHERE l_quantity >= 50) GROUP BY study_id""",
    "linkage": f"""{WITH} SELECT study_id, string_agg(DISTINCT patient, ';' ORDER BY patient) AS source_key, string_agg(DISTINCT patient_id, ';' ORDER BY patient_id) AS original_patient_id, string_agg(DISTINCT patient_name, ';' ORDER BY patient_name) AS original_name, string_agg(DISTINCT study_date, ';' ORDER BY study_date) AS original_study_date,
      string_agg(DISTINCT sex, ';' ORDER BY sex) AS original_sex, string_agg(DISTINCT birth_date, ';' ORDER BY birth_date) AS original_dob, string_agg(DISTINCT scanner, ';' ORDER BY scanner) AS original_manufacturer,
      string_agg(DISTINCT series_number || ': ' || description, ' | ' ORDER BY series_number || ': ' || description) AS original_series_descriptions, count(*) AS files, count(DISTINCT series_number) AS series, count(review) AS review_files, CAST(0 AS BIGINT) AS errors FROM img GROUP BY study_id""",
    "output_names": f"""{WITH} SELECT study_id, folder, count(*) AS files, count(DISTINCT name) AS names, min(name) AS first, max(name) AS last FROM (SELECT study_id, folder, CASE WHEN row_number() OVER (PARTITION BY folder, name ORDER BY path) > 1 THEN substr(name, 1, length(name) - 4) || '_' || counter || '.dcm' ELSE name END AS name FROM ({NAMED}) n) o GROUP BY study_id, folder""",
    "files_log": f"""{WITH} SELECT study_id, status, note, count(*) AS files, count(DISTINCT o) AS outputs, min(o) AS first FROM (SELECT n.study_id, CASE WHEN review IS NULL THEN 'OK' ELSE 'REVIEW' END AS status, coalesce(review, '') AS note,
      folder || '/' || CASE WHEN row_number() OVER (PARTITION BY folder, name ORDER BY n.path) > 1 THEN substr(name, 1, length(name) - 4) || '_' || counter || '.dcm' ELSE name END AS o FROM ({NAMED}) n JOIN (SELECT path, any_value(review) AS review FROM img GROUP BY path) i ON i.path = n.path) t GROUP BY ALL""",
    "verify_findings": f"WITH e AS ({ELEMENTS}) SELECT kind, instance_id, count(*) AS n, sha256(string_agg(detail, ';' ORDER BY detail)) AS details FROM ({RULES} UNION ALL {OBJECT_RULES}) f GROUP BY kind, instance_id",
    "verify_report": f"WITH e AS ({ELEMENTS}), f AS (SELECT kind, instance_id || ': ' || detail AS x FROM ({RULES}) r), n AS (SELECT kind, x, row_number() OVER (PARTITION BY kind ORDER BY x) AS nth FROM f) SELECT kind, count(*) AS findings, string_agg(x, '; ' ORDER BY x) FILTER (nth <= 5) AS examples, greatest(count(*) - 5, 0) AS more FROM n GROUP BY kind",
    "verify_output": "SELECT unnest(['blinded', 'longitudinal', 'characteristics', 'technical']) AS profile, CAST(0 AS BIGINT) AS findings",
    "needle_hits": f"WITH e AS ({ELEMENTS}), t AS ({SWEPT}), n AS (SELECT DISTINCT c_mktsegment AS needle FROM customer) SELECT keyword, needle, count(*) AS hits FROM (SELECT DISTINCT instance_id, keyword, needle FROM t, n WHERE contains(text, needle) AND (keyword NOT IN ('PatientName', 'PatientID') OR text <> needle)) x GROUP BY keyword, needle",
    "name_part_hits": f"WITH e AS ({ELEMENTS}), t AS ({SWEPT}) SELECT keyword, part, count(*) AS hits FROM (SELECT keyword, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{{3,}}'))) AS part FROM t WHERE keyword NOT IN ('PatientName', 'PatientID')) x WHERE part IN (SELECT c_mktsegment FROM customer) GROUP BY keyword, part",
    "nhs_numbers": "SELECT c_custkey, CAST(CASE WHEN k <> 10 AND k = CAST(substr(d, 10, 1) AS INTEGER) THEN 1 ELSE 0 END AS BIGINT) AS valid FROM (SELECT c_custkey, d, (11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr(d, i, 1) AS INTEGER) * (11 - i))) % 11) % 11 AS k FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 100000007 AS VARCHAR), 10, '4') AS d FROM customer) a) b",
    "pattern_sweep": "SELECT c_custkey, c_custkey % 3 = 0 AS postcode, c_custkey % 3 <> 0 AND 1 + c_custkey % 14 <= 12 AS date FROM customer",
    "checksum_recheck": """WITH a AS (SELECT 'f' || o_orderkey AS path, sha256('old' || o_orderkey) AS h FROM orders), b AS (SELECT 'f' || (o_orderkey + CASE WHEN o_totalprice < 2000 THEN 100000000 ELSE 0 END) AS path, sha256(CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END || o_orderkey) AS h FROM orders WHERE o_orderpriority <> '1-URGENT')
      SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'added' WHEN a.h <> b.h THEN 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path) t WHERE state IS NOT NULL""",
    "attestation": """WITH RECURSIVE f AS (SELECT 'f' || o_orderkey AS path, sha256('old' || o_orderkey) AS h FROM orders), d AS (SELECT min(k) AS depth FROM range(0, 13) r(k) WHERE (SELECT count(*) FROM orders) <= 100000 * CAST(16 AS HUGEINT) ** k),
      t AS (SELECT depth AS level, 'r' || substr(sha256(path), 1, depth) AS part, count(*) AS files, sha256(string_agg(h || '  ' || path || chr(10), '' ORDER BY path)) AS digest FROM f, d GROUP BY 1, 2
        UNION ALL SELECT level - 1, substr(part, 1, level), CAST(sum(files) AS BIGINT), sha256(string_agg(digest || chr(10), '' ORDER BY part)) FROM t WHERE level > 0 GROUP BY 1, 2)
      SELECT CAST(coalesce(max(files), 0) AS BIGINT) AS files, coalesce(max(digest), sha256('')) AS digest FROM t WHERE level = 0""",
    "decision_history": HISTORY,
    "decision_counts": f"SELECT count(DISTINCT study_id) AS studies, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'drop') AS dropped, count(*) FILTER (contains(reason, 'CHECK') OR contains(lower(reason), 'fallback')) AS check FROM ({HISTORY}) h".replace("AS check", 'AS "check"'),
    "decision_filter": f"SELECT study_id, series, run FROM ({HISTORY}) h WHERE (contains(reason, 'CHECK') OR contains(lower(reason), 'fallback')) AND contains(lower(study_id), 'u1')",
    "study_units": f"{UNITS} SELECT patient, study, folder, files, series FROM un",
    "mixed_folders": f"{UNITS} SELECT count(*) > 0 AS mixed FROM un a JOIN un b ON a.patient <> b.patient AND (a.folder = b.folder OR starts_with(b.folder, a.folder || '/'))",
    "kinds": f"{KIND} SELECT modality, kind, slice_mm, n_units, n_images, coronary, maybe, sample, note FROM k",
    "kind_search": f"{KIND}, s AS (SELECT *, lower(modality || ' ' || kind || ' ' || {G.format('slice_mm')} || ' mm ' || {G.format('slice_mm')} || 'mm ' || note) AS hay FROM k) SELECT modality, kind, slice_mm, n_units FROM s WHERE contains(hay, 'ct') AND contains(hay, 'cta') AND contains(hay, '0.75mm')",
    "keep_plan": f"""{KIND}, x AS (SELECT *, bool_or(verdict = 'keep') OVER (PARTITION BY study_id) AS any_keep, lower(trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS kind FROM cls),
      p AS (SELECT 'coronary' AS choice, study_id, n_files FROM x WHERE verdict = 'keep' OR (NOT any_keep AND verdict = 'maybe') UNION ALL SELECT 'all', study_id, n_files FROM x UNION ALL SELECT 'choose', x.study_id, x.n_files FROM x JOIN k ON x.modality = k.modality AND x.kind = k.kind AND round(x.slice_mm, 2) = k.slice_mm WHERE coronary > 0)
      SELECT choice, count(DISTINCT study_id) AS n_units, count(study_id) AS n_series, CAST(coalesce(sum(n_files), 0) AS BIGINT) AS n_images, (SELECT count(DISTINCT study_id) FROM cls) - count(DISTINCT study_id) AS empty FROM (SELECT unnest(['coronary', 'all', 'choose']) AS choice) c LEFT JOIN p USING (choice) GROUP BY choice""",
    "assign_ids": f"""WITH g AS ({GIVEN}), top AS (SELECT max(n) AS n FROM (SELECT CAST(regexp_extract(new_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM g UNION ALL SELECT n_nationkey FROM nation) u),
      f AS (SELECT 'P' || s_suppkey AS match_key, n + row_number() OVER (ORDER BY s_suppkey) AS num, n + (SELECT count(*) FROM supplier) AS most FROM supplier, top WHERE s_acctbal <= 5000)
      SELECT match_key, new_id FROM g UNION ALL SELECT match_key, 'ANON-' || lpad(CAST(num AS VARCHAR), CAST(greatest(3, length(CAST(most AS VARCHAR))) AS INTEGER), '0') FROM f""",
    "id_problems": """WITH i AS (SELECT CAST(c_custkey AS VARCHAR) AS match_key, CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 10 = 1 THEN 'a/' || c_custkey WHEN c_custkey % 10 = 2 THEN 'dup ' || (c_custkey % 100) ELSE 'ok' || c_custkey END AS new_id FROM customer)
      SELECT * FROM (SELECT match_key, new_id, CASE WHEN trim(new_id) = '' THEN 'blank' WHEN contains(new_id, '/') THEN 'characters' WHEN count(*) OVER (PARTITION BY new_id) > 1 THEN 'duplicate' END AS problem FROM i) t WHERE problem IS NOT NULL""",
    "earlier_copies": f"SELECT match_key, new_id AS old_id, 'NEW ' || s_suppkey AS new_id FROM ({GIVEN}) g WHERE s_nationkey >= 12 AND new_id IN (SELECT 'ANON-' || CASE WHEN s_suppkey > 999 THEN substr(CAST(s_suppkey AS VARCHAR), 1, 3) ELSE lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END FROM supplier WHERE s_acctbal > 7000)",
    "spreadsheet_ids": "SELECT 'P' || s_suppkey AS match_key, CASE WHEN s_acctbal > 0 THEN 'S' || s_suppkey END AS new_id FROM supplier",
    "assignment_list": f"SELECT coalesce(a.match_key, b.match_key) AS match_key, coalesce(b.new_id, a.new_id) AS new_id FROM ({GIVEN}) a FULL JOIN (SELECT 'P' || s_suppkey AS match_key, 'R' || s_suppkey AS new_id FROM supplier WHERE s_nationkey < 12) b ON a.match_key = b.match_key",
    "resume_pending": "SELECT 'CV' || c_custkey AS study_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000)",
    "study_state": STATE,
    "study_summary": f"""{decisions()}, kp AS (SELECT img.* FROM img JOIN dec ON img.study_id = dec.study_id AND img.series_uid = dec.series_uid WHERE decision = 'keep')
      SELECT d.study_id, count(kp.path) AS files, count(DISTINCT kp.series_number) AS series, count(kp.review) AS review_files, CAST(0 AS BIGINT) AS errors, CASE WHEN count(kp.path) = 0 THEN 'NO CTCA SERIES' ELSE 'OK' END AS status FROM (SELECT DISTINCT study_id FROM dec) d LEFT JOIN kp ON kp.study_id = d.study_id GROUP BY d.study_id
      UNION ALL SELECT 'X' || n_nationkey, 0, 0, 0, 0, 'FOLDER NOT FOUND' FROM nation""",
    "share_readiness": f"""{FACTS}, c AS (SELECT k, 'PASS' = coalesce(status, '') AND verified_at < last_run_at AS stale, 'PASS' = coalesce(status, '') AS passed, * EXCLUDE (k) FROM facts)
      SELECT k AS s_suppkey, level, title FROM (
        SELECT k, 'warn' AS level, 'Check passed, but files have changed since (a run or a redaction)' AS title FROM c WHERE stale UNION ALL SELECT k, 'ok', 'Verify passed' FROM c WHERE passed AND NOT stale UNION ALL SELECT k, 'block', 'Verify FAILED' FROM c WHERE status = 'FAIL' UNION ALL SELECT k, 'block', 'Not verified' FROM c WHERE status IS NULL
        UNION ALL SELECT k, CASE WHEN complete = 0 THEN 'block' ELSE 'ok' END, CASE WHEN complete = 0 THEN 'No completed studies' ELSE complete || ' completed studies' END FROM c UNION ALL SELECT k, 'warn', partial || ' half-finished studies' FROM c WHERE partial > 0 UNION ALL SELECT k, 'warn', review_files || ' quarantined files in _review' FROM c WHERE review_files > 0
        UNION ALL SELECT k, CASE WHEN linkage_files > 0 THEN 'block' ELSE 'ok' END, CASE WHEN linkage_files > 0 THEN linkage_files || ' linkage file(s) still in the output tree' ELSE 'No linkage file in the output tree' END FROM c UNION ALL SELECT k, 'ok', 'Attestation and checksum manifest written' FROM c WHERE passed AND attested
        UNION ALL SELECT k, 'warn', other_logs || ' other confidential log file(s)' FROM c WHERE other_logs > 0) t""",
    "done_headline": f"""{FACTS} SELECT k AS s_suppkey, CASE WHEN complete = 0 AND partial = 0 THEN 'none' WHEN status = 'FAIL' THEN 'error' WHEN status IS NULL OR verified_at < last_run_at THEN 'warn' ELSE 'ok' END AS level,
      CASE WHEN complete = 0 AND partial = 0 THEN 'Nothing has been anonymised yet' WHEN status = 'FAIL' THEN 'Check failed: do not share' ELSE complete || CASE WHEN complete = 1 THEN ' patient' ELSE ' patients' END || CASE WHEN status IS NULL THEN ' anonymised, not yet checked' WHEN verified_at < last_run_at THEN ' anonymised, but changed since the last check' ELSE ' anonymised and verified' END END AS headline FROM facts""",
    "log_progress": """SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'error' WHEN 4 THEN 'warn' ELSE 'plain' END AS "class", CASE WHEN event_id % 5 = 0 THEN event_id % 520 END AS done, CASE WHEN event_id % 5 = 0 THEN CAST(520 AS BIGINT) END AS total, CASE WHEN event_id % 5 = 0 THEN 'U' || user_id END AS study,
      CASE WHEN event_id % 5 = 0 THEN (event_id % 520) * 100 // 520 END AS percent, CASE WHEN event_id % 5 = 0 THEN CAST(310 AS BIGINT) END AS minutes_left, false AS skipped FROM events""",
    "frame_window": f"""SELECT vec_id AS instance_id, array_to_string(list_transform(q, lambda v: CAST(floor(least(255.0, greatest(0.0, (v - lo) * (255.0 / (hi - lo))))) AS INTEGER)), ',') AS grey FROM (SELECT vec_id, q, CASE WHEN vec_id % 3 = 0 THEN list_min(q) ELSE -20.0 END AS lo, CASE WHEN vec_id % 3 = 0 THEN list_max(q) ELSE 20.0 END AS hi FROM (SELECT vec_id, list_transform(p, lambda v: v * 2 - 10) AS q FROM ({PIX}) a) b) c""",
    "frame_redact": f"""SELECT vec_id AS instance_id, array_to_string(list_transform(p, lambda v, i: CAST(CASE WHEN (i - 1) % 8 >= least(vec_id % 9, 4) AND (i - 1) % 8 < greatest(vec_id % 9, 4) AND (i - 1) // 8 < vec_id % 5 THEN CASE WHEN vec_id % 2 = 0 THEN list_max(p) ELSE 0 END ELSE v END AS BIGINT)), ',') AS pixels FROM ({PIX}) a""",
    "frame_downsample": f"SELECT vec_id AS instance_id, array_to_string(list_transform(range(0, 12), lambda k: CAST(p[CAST(round_even((k // 4) * 7 / 2.0, 0) * 8 + round_even((k % 4) * 7 / 3.0, 0) AS INTEGER) + 1] AS BIGINT)), ',') AS pixels FROM ({PIX}) a",
    "slice_spacing": "SELECT series_uid, count(*) AS slices, CASE WHEN median(gap) > 0 THEN median(gap) ELSE 1.0::DOUBLE END AS spacing FROM (SELECT 'L' || label AS series_uid, vec_id * 0.5::DOUBLE - lag(vec_id * 0.5::DOUBLE) OVER (PARTITION BY label ORDER BY vec_id) AS gap FROM embeddings) t GROUP BY series_uid",
    "reformat": f"""SELECT 'L' || label AS series_uid, sha256(string_agg(array_to_string(list_transform(p[25:32], lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY vec_id DESC)) AS coronal, sha256(string_agg(array_to_string(list_transform(range(0, 8), lambda r: CAST(p[r * 8 + 8] AS BIGINT)), ','), ',' ORDER BY vec_id DESC)) AS sagittal FROM ({PIX}) a GROUP BY label""",
}
SQL["run_totals"] = f"SELECT count(*) AS studies, CAST(sum(files) AS BIGINT) AS files, CAST(sum(series) AS BIGINT) AS series, CAST(sum(review_files) AS BIGINT) AS review_files, count(*) FILTER (files = 0) AS empty, array_to_string(list_sort(list(study_id) FILTER (files = 0))[1:20], ', ') AS first_empty FROM ({SQL['study_summary']}) s"

_DATE = "strftime(strptime(value, '%Y%m%d'), '%-d %b %Y')"
SQL["plain_changes"] = f"""WITH e AS ({ELEMENTS}), f AS (SELECT instance_id, study_id, path, CASE path WHEN 'PatientName' THEN 'Name' WHEN 'PatientID' THEN 'Hospital number' WHEN 'PatientBirthDate' THEN 'Date of birth' WHEN 'PatientSex' THEN 'Sex' WHEN 'PatientAge' THEN 'Age'
    WHEN 'StudyDate' THEN 'Scan date' WHEN 'InstitutionName' THEN 'Hospital' WHEN 'ReferringPhysicianName' THEN 'Referring doctor' WHEN 'AccessionNumber' THEN 'Accession number' WHEN 'Manufacturer' THEN 'Scanner' WHEN 'ManufacturerModelName' THEN 'Scanner' WHEN 'ImageComments' THEN 'Comments' END AS label,
  CASE path WHEN 'PatientName' THEN replace(value, '^', ' ') WHEN 'ReferringPhysicianName' THEN replace(value, '^', ' ') WHEN 'PatientBirthDate' THEN {_DATE} WHEN 'StudyDate' THEN {_DATE} WHEN 'PatientSex' THEN CASE value WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'other' END
    WHEN 'PatientAge' THEN CASE value WHEN '030M' THEN '30 months' ELSE '58 years' END ELSE value END AS shown FROM e WHERE value <> '')
SELECT instance_id, label, string_agg(shown, ' ' ORDER BY path) AS before, max(CASE WHEN path IN ('PatientName', 'PatientID') THEN study_id WHEN path = 'StudyDate' THEN '1 Jan 1900 (dummy)' ELSE 'removed' END) AS after,
  max(CASE WHEN path IN ('PatientName', 'PatientID', 'StudyDate') THEN 'replaced' ELSE 'removed' END) AS state FROM f WHERE label IS NOT NULL GROUP BY instance_id, label"""
