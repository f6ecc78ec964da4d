"""SQL of `table_queries`, written apart from the operators."""

from __future__ import annotations

from ..functions import policy as P
from . import oracle as O
from .table_queries import LISTED, TRIAL

LISTED_SQL = LISTED


def digest(lines: str) -> str:
    """Per object, how many lines there are and one digest of them in order; `lines` is a query of instance_id and line."""
    return f"SELECT instance_id, count(*) AS attributes, sha256(string_agg(line, ';' ORDER BY line)) AS digest FROM ({lines}) f GROUP BY instance_id"


def uses() -> str:
    out = []
    for name, p in {**P.PROFILES, "trial": TRIAL}.items():
        kept = p.retained()
        acts = {"remove": [k for k in P.REMOVE if k not in kept], "clear": [k for k in P.CLEAR if k not in kept], "vendor": [] if p.keep_technical else P.VENDOR_HINTS, "keep_uid": P.UID_KEEP, "meta": P.META_FORBIDDEN}
        said = {"blinded": ("Cohort Veil 1.0.0 full blind", "nothing retained."), "longitudinal": ("Cohort Veil 1.0.0 kept:sex,age5y,dates-shifted", "retains sex, age5y, dates-shifted."), "characteristics": ("Cohort Veil 1.0.0 kept:sex,age5y,weight", "retains sex, age5y, weight."), "technical": ("Cohort Veil 1.0.0 kept:scanner,technical", "retains scanner, technical."), "trial": ("by protocol 7", "retains sex.")}[name]
        out += [f"SELECT '{name}' AS profile, '{said[0]}' AS method, 'Removes everything identifying; {said[1]}' AS describes, CAST(0 AS BIGINT) AS problems, '{a}' AS action, count(*) AS attributes FROM e WHERE (grp = 'meta' OR NOT nested) AND path IN ({O.words(w)}) HAVING count(*) > 0" for a, w in acts.items() if w]
    return f"WITH e AS ({O.ELEMENTS}) " + " UNION ALL ".join(out)


TRIAL_FIN = O.policy_sql(("PatientSex",), method="by protocol 7").replace("'data:PatientName=' || study_id", "'data:PatientName=TRIAL^CASE'").replace("'data:PatientIdentityRemoved=YES'", "'data:StudyDescription=Trial CT', 'data:PatientIdentityRemoved=YES'").replace("path NOT IN ('PatientName',", "path NOT IN ('StudyDescription', 'PatientName',")
JSON_LINES = """SELECT o_orderkey AS instance_id, unnest(['meta:SourceApplicationEntityTitle=ARCHIVE7', CASE WHEN o_orderkey % 5 <> 0 THEN 'data:SOPClassUID=1.2.840.10008.5.1.4.1.1.2' END, 'data:SOPInstanceUID=1.8.' || o_orderkey, 'data:PatientName=' || c_mktsegment || '^A', 'data:PatientBirthName=' || c_name,
  'data:PatientTelephoneNumbers=' || o_orderkey, 'data:InstanceNumber=' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'data:SliceThickness=0.75' END, 'data:NominalPercentageOfCardiacPhase=' || CASE WHEN o_orderkey % 3 = 0 THEN '75' ELSE '' END, 'data:(0009,1001)=3',
  'data:SharedFunctionalGroupsSequence=1', 'data:SharedFunctionalGroupsSequence[0].ReferencedSOPInstanceUID=1.7.' || o_orderkey, 'data:SharedFunctionalGroupsSequence[0].(0028,9110)=1', 'data:SharedFunctionalGroupsSequence[0].(0028,9110)[0].SliceThickness=' || (o_custkey % 7 + 0.5)]) AS line FROM orders JOIN customer ON o_custkey = c_custkey"""
IMG = O.WITH.strip()

SQL = {
    "remap_paths": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '/mnt/out/' WHEN 2 THEN '/data/inner/' || s_name ELSE '/mnt/out/' || s_name END AS path FROM supplier",
    "redact_paths": "SELECT c_custkey, 'read /home/<user>/scan and C:\\Users\\<user>\\x, not /var/' || c_mktsegment AS line FROM customer",
    "split_needles": "SELECT c_custkey, c_name || '|' || c_mktsegment || '|' || c_custkey AS needles FROM customer",
    "profile_slugs": "SELECT c_custkey, lower(c_mktsegment) || '-no-' || c_custkey AS slug FROM customer",
    "time_left": """SELECT o_orderkey, CASE WHEN e < 8 OR f < 0.03 OR f >= 1 THEN '' WHEN s < 50 THEN 'under a minute left' WHEN m < 90 THEN 'about ' || greatest(1, m) || ' min left' ELSE 'about ' || m // 60 || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || ' min left' END AS "left"
      FROM (SELECT *, e * (1 - f) / f AS s, CAST(round_even(e * (1 - f) / nullif(f, 0) / 60, 0) AS BIGINT) AS m FROM (SELECT o_orderkey, CAST(o_orderkey % 40000 AS DOUBLE) AS e, o_custkey % 101 / 100.0::DOUBLE AS f FROM orders) a) b""",
    "unit_labels": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'ward ' || s_nationkey ELSE s_name || '/x' END AS label FROM supplier",
    "policy_use": uses(),
    "tag_policy_texts": f"WITH {TRIAL_FIN} {O.DIGEST}",
    "verify_texts": f"WITH e AS ({O.ELEMENTS}) SELECT 'attribute should match profile' AS kind, instance_id, 'StudyDescription=' || value AS detail FROM e WHERE path = 'StudyDescription' AND value NOT IN ('', 'Trial CT') UNION ALL SELECT 'PatientName not as profile dictates', instance_id, value || ' / expected TRIAL^CASE' FROM e WHERE path = 'PatientName'",
    "json_elements": digest(f"SELECT * FROM ({JSON_LINES}) j WHERE line IS NOT NULL"),
    "json_headers": "SELECT o_orderkey AS instance_id, c_mktsegment || '^A' AS patient_name, CAST(o_orderkey AS VARCHAR) AS instance_number, CASE WHEN o_orderkey % 2 = 0 THEN 0.75::DOUBLE ELSE o_custkey % 7 + 0.5::DOUBLE END AS slice_mm, CASE WHEN o_orderkey % 3 = 0 THEN 75.0::DOUBLE END AS phase FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0",
    "rejected_objects": f"""SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 11 = 0 THEN 'not JSON' WHEN o_orderkey % 13 = 0 THEN 'not an object' WHEN o_orderkey % 17 = 0 THEN 'sequences nested more than 12 deep' ELSE '' END AS fault,
      CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 0 ELSE (SELECT count(*) FROM ({JSON_LINES}) j WHERE j.instance_id = o_orderkey AND line IS NOT NULL) END AS elements FROM orders JOIN customer ON o_custkey = c_custkey""",
    "default_windows": f"SELECT vec_id AS instance_id, CASE WHEN p[3] > 0 THEN p[1] END AS centre, CASE WHEN p[3] > 0 THEN p[3] END AS width, p[CAST((vec_id % 5) * 8 + vec_id % 8 AS INTEGER) + 1] AS value FROM ({O.PIX}) a",
    "quarantine_release": f"""SELECT vec_id AS instance_id, 'CV1' AS study_id, 'study' AS route, CASE WHEN vec_id % 15 = 0 THEN '' ELSE array_to_string(list_transform(p, lambda v, i: CAST(CASE WHEN (vec_id % 5 = 0 OR vec_id % 4 = 0) AND (i - 1) % 8 IN (1, 2) AND (i - 1) // 8 = 1 THEN CASE WHEN vec_id % 2 = 0 THEN list_max(p) ELSE 0 END ELSE v END AS BIGINT)), ',') END AS pixels
      FROM ({O.PIX}) a WHERE vec_id % 3 = 0 AND vec_id % 15 <> 0""",
    "redaction_log": "SELECT '20240101' AS time, l_orderkey AS instance_id, count(*) AS boxes, 'reader' AS by FROM lineitem GROUP BY l_orderkey".replace("AS by", 'AS "by"'),
    "wanted_files": f"""SELECT rel, NOT regexp_matches(rel, '(^|/)(_logs|_review|\\.)') AND NOT regexp_matches(rel, '/DicomDir$') AND NOT regexp_matches(lower(rel), '\\.png$') AS run,
      NOT regexp_matches(rel, '(^|/)(_|\\.)') AND NOT regexp_matches(rel, '/DicomDir$') AND NOT regexp_matches(lower(rel), '\\.(png|zip)$') AS survey, count(*) AS files FROM (SELECT {LISTED_SQL} AS rel FROM lineitem) l GROUP BY rel""",
    "earlier_outputs": "SELECT 'out' || s_nationkey AS folder FROM supplier GROUP BY s_nationkey HAVING bool_or(s_suppkey % 2 = 0) AND bool_or(s_suppkey % 3 = 0)",
    "mapping_file": "SELECT upper(c_name) AS key, 'CV' || c_custkey AS study_id FROM customer WHERE c_custkey % 9 <> 0",
    "pair_files": """WITH s AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'P' || s_suppkey END AS study_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'u' || s_suppkey END AS series_uid, s_name AS series_description FROM supplier)
      SELECT 'selection' AS what, study_id, series_uid, '' AS series_description FROM s WHERE study_id <> '' AND series_uid <> '' UNION ALL SELECT 'picks', study_id, series_uid, series_description FROM s WHERE study_id <> ''""",
    "skip_file": "SELECT '/a/' || s_name AS path FROM supplier WHERE s_suppkey % 4 >= 2",
    "checksum_file": "SELECT 'f' || o_orderkey AS path, sha256('old' || o_orderkey) AS sha256 FROM orders",
    "linkage_words": f"{IMG}, w AS (SELECT upper(trim(unnest([patient_id, patient_name, study_date, birth_date]))) AS needle FROM img) SELECT DISTINCT needle FROM w WHERE length(needle) >= 4 AND needle NOT IN ('19000101', '00010101')",
    "report_status": "SELECT CASE event_id % 5 WHEN 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM events WHERE user_id % 10 = (SELECT max(user_id % 10) FROM events) AND event_id % 5 < 2 ORDER BY event_id LIMIT 1",
    "confidential_files": """SELECT name, kind, count(*) AS files FROM (SELECT unnest(['LINKAGE_1.csv', 'verify_1.txt', 'verify_2.txt', 'checksums_1.sha256', 'attestation_1.json', 'profile.json', 'files_1.csv']) AS name, unnest(['linkage', 'plain', 'confidential', 'plain', 'plain', 'plain', 'confidential']) AS kind, unnest(range(7)) AS k) n JOIN events ON event_id % 7 = k GROUP BY name, kind""",
    "attestation_text": f"""SELECT '{{"tool":"Cohort Veil","version":"1.0.0","verified_at":"20240101","profile":{{"name":"Longitudinal follow-up","retains":["sex","age5y","dates-shifted"],"method":"Cohort Veil 1.0.0 kept:sex,age5y,dates-shifted"}},"output":{{"patients_marked_complete":' || (SELECT count(*) FROM ({O.STATE}) s WHERE state = 'complete')
      || ',"objects_verified":' || (SELECT count(*) FROM customer) || ',"files_hashed":' || files || '}},"verify":{{"result":"PASS","needles_used":5}},"checksums":{{"sha256":"' || digest || '"}}}}' AS attestation FROM ({O.SQL['attestation']}) d""",
    "not_this_run": "SELECT 'C V ' || c_custkey AS study_id FROM customer WHERE NOT c_acctbal > 0",
    "survey_copies": f"""{IMG}, own AS (SELECT *, patient || '/' || l_orderkey || '/' || l_linenumber AS src, patient || '/S' || lpad(CAST(series_number AS VARCHAR), 3, '0') AS folder FROM img), k AS (SELECT patient, series_uid FROM own GROUP BY ALL HAVING count(*) % 2 = 0),
      n AS (SELECT src, folder, l_linenumber AS name, row_number() OVER (PARTITION BY folder, l_linenumber ORDER BY src) - 1 AS nth FROM own JOIN k USING (patient, series_uid)), t AS (SELECT folder, src, folder || '/' || CASE WHEN nth = 0 THEN '' ELSE nth || '_' END || name AS target FROM n)
      SELECT folder, count(*) AS files, count(DISTINCT target) AS targets, sha256(string_agg(src || '>' || target, ';' ORDER BY src || '>' || target)) AS digest FROM t GROUP BY folder""",
    "case_mismatch": "SELECT 'F' || l_suppkey % 7 AS source_folder, count(DISTINCT l_suppkey) AS patients FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "coronary_summary": f"{IMG} SELECT study_id, CASE WHEN count(*) FILTER (verdict = 'keep') > 0 THEN 'keep ' || count(*) FILTER (verdict = 'keep') || ' series' WHEN bool_or(verdict = 'maybe') THEN 'possibly' ELSE 'none' END AS found FROM cls GROUP BY study_id",
    "output_series": f"{O.decisions()} SELECT study_id, series_uid, images AS n_files, 'keep' AS verdict, reason FROM dec WHERE decision = 'keep' UNION ALL SELECT study_id, series_uid, count(*), 'review', 'quarantined: ' || min(review) FROM img WHERE review IS NOT NULL GROUP BY study_id, series_uid",
    "ticked_kinds": f"{O.KIND}, a AS (SELECT modality, kind, slice_mm FROM k WHERE slice_mm < 0.7), b AS (SELECT modality, kind, slice_mm FROM k WHERE kind LIKE '%a%') SELECT *, true AS ticked FROM (SELECT * FROM a UNION SELECT * FROM b) u UNION ALL SELECT *, false FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x",
    "selection_table": f"""{IMG} SELECT study_id, series_uid FROM ser WHERE CAST(substr(study_id, 2) AS BIGINT) % 5 <> 0 AND CAST(substr(study_id, 2) AS BIGINT) % 3 <> 0 AND CAST(substr(study_id, 2) AS BIGINT) % 7 <> 0
      UNION ALL SELECT 'P' || s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 AND s_suppkey % 7 <> 0""",
    "pick_override": f"{IMG} SELECT *, CAST(NULL AS VARCHAR) AS warning FROM ({O.PICKS}) p WHERE study_id <> 'P2' UNION ALL SELECT study_id, series_uid, description, CASE WHEN slice_mm > 0.8 THEN 'thicker than 0.8 mm: the thin coronary series is used instead' END FROM cls WHERE study_id = 'P2'",
    "middle_files": f"{IMG} SELECT series_uid, path FROM (SELECT series_uid, path, row_number() OVER (PARTITION BY series_uid ORDER BY path) AS nth, count(*) OVER (PARTITION BY series_uid) AS n FROM img) t WHERE nth = (n + 1) // 2",
    "started_studies": "SELECT 'U' || user_id AS study, CASE event_id % 3 WHEN 0 THEN CAST(224 AS BIGINT) END AS expected, CASE event_id % 3 WHEN 1 THEN CAST(200 AS BIGINT) END AS written, count(*) AS lines FROM events WHERE event_id % 3 < 2 GROUP BY ALL",
    "skip_hits": f"{IMG} SELECT study_id, count(*) AS skipped FROM img WHERE path IN (SELECT path FROM img WHERE l_linenumber = 2) GROUP BY study_id",
    "scan_headline": f"""{O.UNITS}, t AS (SELECT count(DISTINCT coalesce(patient, folder)) AS patients, count(*) AS units, CAST(sum(series) AS BIGINT) AS series, CAST(sum(files) AS BIGINT) AS images FROM un)
      SELECT *, CASE WHEN patients = units THEN CASE WHEN units = 1 THEN 'patient' ELSE 'patients' END ELSE 'studies' END AS noun, 'Found ' || CASE WHEN patients = units THEN patients || CASE WHEN patients = 1 THEN ' patient' ELSE ' patients' END ELSE units || ' studies from ' || patients || ' patients' END || ': ' || series || ' series, ' || format('{{:,}}', images) || ' images.' AS headline FROM t""",
    "reused_ids": f"""WITH k AS (SELECT match_key, new_id FROM ({O.GIVEN}) g WHERE new_id IN (SELECT 'ANON-' || CASE WHEN s_suppkey > 999 THEN substr(CAST(s_suppkey AS VARCHAR), 1, 3) ELSE lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END FROM supplier WHERE s_suppkey % 2 = 0)), top AS (SELECT coalesce(max(CASE WHEN s_suppkey > 999 THEN CAST(substr(CAST(s_suppkey AS VARCHAR), 1, 3) AS BIGINT) ELSE s_suppkey END), 0) AS n FROM supplier WHERE s_suppkey % 2 = 0),
      f AS (SELECT 'P' || s_suppkey AS match_key, n + row_number() OVER (ORDER BY s_suppkey) AS num, n + (SELECT count(*) FROM supplier) AS most FROM supplier, top WHERE 'P' || s_suppkey NOT IN (SELECT match_key FROM k))
      SELECT match_key, new_id FROM k UNION ALL SELECT match_key, 'ANON-' || lpad(CAST(num AS VARCHAR), CAST(greatest(3, length(CAST(most AS VARCHAR))) AS INTEGER), '0') FROM f""",
    "first_names": "SELECT count(*) AS names, array_to_string(list_sort(list(c_name))[1:4], ', ') || CASE WHEN count(*) > 4 THEN ' and ' || (count(*) - 4) || ' more' ELSE '' END AS shown FROM (SELECT DISTINCT c_name FROM customer WHERE c_acctbal < 0) c",
    "tick_counts": f"WITH t AS (SELECT study_id, count(DISTINCT series_uid) AS ticked FROM ({O.SELECTION}) s GROUP BY study_id) SELECT study_id, ticked, CAST(1 AS BIGINT) AS studies FROM t UNION ALL SELECT NULL, CAST(coalesce(sum(ticked), 0) AS BIGINT), count(*) FROM t",
    "tiled_redact": f"""WITH a AS ({O.PIX}), t AS (SELECT *, unnest(range(0, 16)) AS k FROM a), u AS (SELECT vec_id, p, k // 4 AS frame, (k % 4) // 2 * 3 AS row0, k % 2 * 3 AS col0 FROM t)
      SELECT vec_id AS instance_id, CAST(frame AS INTEGER) AS frame, CAST(row0 AS INTEGER) AS row0, CAST(col0 AS INTEGER) AS col0, (SELECT string_agg(CAST(CASE WHEN c >= least(vec_id % 5, 2) AND c < least(greatest(vec_id % 5, 2), 4) AND r < least(vec_id % 6, 4) THEN CASE WHEN vec_id % 2 = 0 THEN list_max(p) ELSE 0 END ELSE p[CAST(frame * 16 + r * 4 + c + 1 AS INTEGER)] END AS BIGINT), ',' ORDER BY r, c)
        FROM range(0, 4) x(r), range(0, 4) y(c) WHERE r // 3 * 3 = row0 AND c // 3 * 3 = col0) AS pixels FROM u""",
    "tiled_reformat": f"""WITH a AS (SELECT 'L' || label AS series_uid, p, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY label) AS n FROM ({O.PIX}) x),
      v AS (SELECT series_uid, p, nth, n, unnest(range(0, 64)) AS k FROM a), w AS (SELECT series_uid, nth, n, k // 8 AS y, k % 8 AS x, CAST(p[CAST(k + 1 AS INTEGER)] AS BIGINT) AS q FROM v),
      o AS (SELECT 'Axial' AS orientation, series_uid, y // 3 * 3 AS row0, x // 3 * 3 AS col0, y AS r, x AS c, q FROM w WHERE nth = least(7, n - 1) UNION ALL
        SELECT 'Coronal', series_uid, (n - 1 - nth) // 5 * 5, x // 3 * 3, n - 1 - nth, x, q FROM w WHERE y = 3 UNION ALL SELECT 'Sagittal', series_uid, (n - 1 - nth) // 5 * 5, y // 3 * 3, n - 1 - nth, y, q FROM w WHERE x = 7)
      SELECT orientation, series_uid, CAST(row0 AS INTEGER) AS row0, CAST(col0 AS INTEGER) AS col0, string_agg(q, ',' ORDER BY r, c) AS pixels FROM o GROUP BY orientation, series_uid, row0, col0""",
    "input_files": """WITH o AS (SELECT 'out' || s_nationkey AS folder FROM supplier GROUP BY s_nationkey HAVING bool_or(s_suppkey % 2 = 0) AND bool_or(s_suppkey % 3 = 0)),
      l AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'out' || l_suppkey % 25 || '/S/' WHEN 1 THEN 'in/out' || l_suppkey % 25 || '/' ELSE '' END AS folder FROM lineitem) SELECT folder, count(*) AS files FROM l WHERE NOT (starts_with(folder, 'out') AND split_part(folder, '/', 1) IN (SELECT folder FROM o)) GROUP BY folder""",
    "needle_words": f"""{IMG}, w AS (SELECT unnest([patient_id, patient_name, study_date, birth_date]) AS v FROM img UNION ALL SELECT c_name FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT unnest([c_mktsegment, c_name, 'x1']) FROM customer WHERE c_custkey % 7 = 0)
      SELECT DISTINCT upper(trim(v)) AS needle FROM w WHERE length(trim(v)) >= 4 AND trim(v) NOT IN ('19000101', '00010101')""",
    "manifest_tree": """WITH f AS (SELECT 'f' || o_orderkey AS path, sha256('old' || o_orderkey) AS h FROM orders), p AS (SELECT 'r' || substr(sha256(path), 1, 2) AS part, count(*) AS files, sha256(string_agg(h || '  ' || path || chr(10), '' ORDER BY path)) AS d FROM f GROUP BY 1),
      q AS (SELECT substr(part, 1, 2) AS part, CAST(sum(files) AS BIGINT) AS files, sha256(string_agg(d || chr(10), '' ORDER BY part)) AS d FROM p GROUP BY 1), z AS (SELECT 'r' AS part, CAST(sum(files) AS BIGINT) AS files, sha256(string_agg(d || chr(10), '' ORDER BY part)) AS d FROM q)
      SELECT 2 AS level, part, files, d AS sha256 FROM p UNION ALL SELECT 1, * FROM q UNION ALL SELECT 0, * FROM z""",
    "tree_recheck": O.SQL["checksum_recheck"],
    "study_counts": f"""{O.decisions()}, kp AS (SELECT img.* FROM img JOIN dec ON img.study_id = dec.study_id AND img.series_uid = dec.series_uid WHERE decision = 'keep'),
      er AS (SELECT study_id, count(*) AS errors FROM (SELECT CASE WHEN l_linenumber = 2 THEN 'Q' || l_suppkey ELSE 'P' || l_suppkey END AS study_id FROM lineitem WHERE l_partkey % 50 = 0 AND l_linenumber <> 1) b GROUP BY 1),
      d AS (SELECT study_id, CAST(sum(CASE WHEN decision = 'keep' THEN 0 ELSE images END) AS BIGINT) AS dropped FROM dec GROUP BY 1), k AS (SELECT study_id, count(*) AS files, count(DISTINCT series_number) AS series, count(review) AS review_files FROM kp GROUP BY 1)
      SELECT coalesce(d.study_id, er.study_id) AS study_id, coalesce(files, 0) AS files, coalesce(series, 0) AS series, coalesce(review_files, 0) AS review_files, coalesce(dropped, 0) AS dropped, coalesce(errors, 0) AS errors FROM d FULL JOIN er ON er.study_id = d.study_id LEFT JOIN k ON k.study_id = d.study_id""",
    "versioned_list": "SELECT c_custkey AS match_key, CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE 'A' END || c_custkey AS new_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "saved_selection": f"""{O.decisions()}, t AS (SELECT study_id, series_uid FROM cls), s AS (SELECT 'P' || s_suppkey AS study_id, s_suppkey AS k FROM supplier),
      u AS (SELECT * FROM t WHERE study_id NOT IN (SELECT study_id FROM s WHERE k % 3 = 0) UNION ALL SELECT study_id, 'new' FROM s WHERE k % 3 = 0 AND k % 2 = 1) SELECT * FROM u WHERE study_id NOT IN (SELECT study_id FROM s WHERE k % 7 = 0)""",
    "written_profile": f"WITH {TRIAL_FIN} {O.DIGEST}",
    "decisions_file": f"{O.decisions()} SELECT CASE WHEN decision = 'keep' THEN '1' ELSE '2' END AS run, decision, count(*) AS series, count(DISTINCT study_id) AS studies FROM dec GROUP BY ALL",
    "run_files": """WITH o AS (SELECT 'CV' || o_custkey AS study_id, o_orderkey % 10 = 0 AS bad FROM orders WHERE o_custkey % 4 <> 0), d AS (SELECT study_id AS s, bool_or(NOT bad) AS has_files, NOT bool_or(bad) AS complete FROM o GROUP BY 1)
      SELECT study_id, CASE WHEN bad THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS files, CASE WHEN any_value(has_files) THEN any_value(complete) END AS complete FROM o JOIN d ON s = study_id GROUP BY study_id, bad
      UNION ALL SELECT NULL, 'ERROR', count(*), NULL FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 10 = 0 HAVING count(*) > 0""",
    "dry_run": "SELECT 'CV' || o_custkey AS study_id, 'H' || (1000000 + o_custkey) AS source_keys, count(*) AS files, CAST(0 AS BIGINT) AS series, CAST(0 AS BIGINT) AS review_files, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS errors, 'OK' AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY o_custkey",
    "run_output": f"WITH {O.policy_sql()} SELECT instance_id, count(*) AS attributes, sha256(string_agg(line, ';' ORDER BY line)) AS digest FROM fin WHERE instance_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) GROUP BY instance_id",
}

O_NHS = "([0-9]{3}(?:  |--)?[0-9]{3}(?:  |--)?[0-9]{4})"
VALID = "(11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr(d, i, 1) AS INTEGER) * (11 - i))) % 11) % 11"
#: Separators are doubled, so that one can end a number and another begin the next.
SQL["document_sweep"] = f"""WITH t AS (SELECT source, coalesce(text, '') AS text FROM documents),
n AS (SELECT source, regexp_matches(upper(text), '\\b[A-Z]{{1,2}}[0-9][A-Z0-9]? [0-9][A-Z]{{2}}\\b') AS postcode, list_transform(regexp_extract_all(regexp_replace(text, '([^0-9A-Z])', '\\1\\1', 'g'), '(?:^|[^0-9A-Z]){O_NHS}(?:[^0-9A-Z]|$)', 1), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS found FROM t)
SELECT source, count(*) AS texts, count(*) FILTER (postcode) AS postcodes, CAST(sum(len(list_filter(found, lambda d: {VALID} <> 10 AND {VALID} = CAST(substr(d, 10, 1) AS INTEGER)))) AS BIGINT) AS nhs FROM n GROUP BY source"""
