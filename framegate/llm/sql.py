"""ANSI SQL for the p queries that SQL can express over whole tables; keys as in queries.QUERIES."""

import unicodedata

_KEY = "replace(replace(lower(trim({0}, ' ' || chr(9) || chr(10))), '-', '_'), ' ', '_')"
_LATEST_LABELS = "SELECT * FROM labeled_events QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY ingested_at DESC) = 1"
_LATEST_EVENTS = "SELECT * FROM perception_events QUALIFY row_number() OVER (PARTITION BY video_path, sequence_no ORDER BY ingested_at DESC) = 1"
_LATEST_CANDIDATES = "SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY video_path, frame_index ORDER BY ingested_at DESC) = 1"
#: The video of each case, with the spellings that the tables use resolved: '.', empty and 'x/..' steps.
_CASES = r"""SELECT case_id, max(regexp_replace(regexp_replace(regexp_replace(regexp_replace(video, '/\.(/|$)', '/', 'g'), '/+', '/', 'g'), '^\./', ''), '(^|/)[^/]+/\.\.(/|$)', '\1', 'g')) AS video
  FROM evaluation_cases WHERE case_id IS NOT NULL GROUP BY case_id"""
_RUNS = f"""WITH e AS ({_LATEST_EVENTS}),
n AS (SELECT video_path, sequence_no, lower(trim(reason)) AS reason, CASE WHEN NOT isnan(change_fraction) THEN change_fraction END AS cf, CASE WHEN NOT isnan(timestamp_s) THEN timestamp_s END AS ts FROM e),
b AS (SELECT *, CASE WHEN reason = lag(reason) OVER w AND round(abs(cf - lag(cf) OVER w), 9) <= 0.01 AND round(abs(ts - lag(ts) OVER w), 9) <= 2.0 THEN 0 ELSE 1 END AS brk
  FROM n WINDOW w AS (PARTITION BY video_path ORDER BY sequence_no)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY video_path ORDER BY sequence_no) AS run FROM b),
r AS (SELECT video_path, min(sequence_no) AS first_sequence, max(sequence_no) AS last_sequence, count(*) AS events, min_by(ts, sequence_no) AS started, max_by(ts, sequence_no) AS ended, min_by(reason, sequence_no) AS kind
  FROM g GROUP BY video_path, run)
"""
_REPORT = f"""WITH x AS (SELECT coalesce({_KEY.format("category")}, 'other') AS c, coalesce({_KEY.format("risk")}, 'normal') AS r FROM ({_LATEST_LABELS})),
t AS (SELECT profile_id, target_id, {_KEY.format("category")} AS category, {_KEY.format("risk")} AS risk,
  greatest(coalesce(min_rows, 0), round(coalesce(CAST(target_share AS DECIMAL(20,9)) * sample_size, 0)))::BIGINT AS needed FROM sample_profiles),
y AS (SELECT t.*, (SELECT count(*) FROM x WHERE x.c = t.category AND (t.risk IS NULL OR x.r = t.risk)) AS existing FROM t)
"""

_SCORES = ("frame_difference", "histogram_difference", "motion_score", "importance")
_RANKED = f"""WITH c AS (SELECT * FROM ({_LATEST_CANDIDATES}) SEMI JOIN rank_panel USING (video_path)),
l AS ({" UNION ALL ".join(f"SELECT video_path, frame_index, analyzer_build, {i} AS s, CASE WHEN NOT isnan({c}) THEN {c} END AS v FROM c" for i, c in enumerate(_SCORES))}),
q AS (SELECT *, rank() OVER (PARTITION BY video_path, analyzer_build, s ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY video_path, analyzer_build, s, v) AS same, count(*) OVER (PARTITION BY video_path, analyzer_build, s) AS n FROM l WHERE v IS NOT NULL),
k AS (SELECT l.video_path, l.frame_index, list_sort(list(coalesce(CASE WHEN n = 1 THEN 1.0 ELSE (below + (same - 1) / 2.0) / (n - 1) END, -1.0))) AS a, max(n) IS NULL AS none FROM l LEFT JOIN q ON q.video_path = l.video_path AND q.frame_index = l.frame_index AND q.s = l.s GROUP BY 1, 2),
r AS (SELECT video_path, frame_index, none, row_number() OVER (PARTITION BY video_path ORDER BY a[2] DESC, a[3] DESC, a[4] DESC, a[1] DESC, frame_index) AS place FROM k)
"""


# Fixed values, stated apart from the operator's: letters of one shape, the one that stands for all first.
_ALIKE = (
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜϺ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YҮΥ ZΖ aаα cсϲ dԁ eе hһ iіι jјϳ lӏ oоο pрρ qԛ sѕ uυ vѵν wԝ xх yуγү "
    "ГΓ ПΠ ФΦ кκ ÞϷ þϸ ƩΣ ƷӠ ʒӡ ΨѰ ψѱ ИͶ иͷ ӘƏ әəǝ ĐÐƉ ӨΘƟѲ өѳɵ εɛ μµ"
).split()
_LETTER = {ord(c): group[0] for group in _ALIKE for c in group[1:]}
# Characters of other categories than Cf and Cc that have no width, and those of Cf that are drawn; tabs and line ends stay.
_HIDDEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}
_SEEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2}
_LINES = {9, 10, 11, 12, 13, 0x85, 0x2028, 0x2029}


def _stands(cp: int) -> str:
    """What stands for a character of the first plane."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if cp in _HIDDEN or (kind in ("Cf", "Cc") and cp not in _SEEN and cp not in _LINES):
        return ""
    if kind == "Zs":
        return " "
    how, *parts = unicodedata.decomposition(c).split() or [""]
    if how in ("<wide>", "<narrow>"):
        c = "".join(chr(int(x, 16)) for x in parts)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(_LETTER))


def _form(text: str) -> str:
    """The look-alike form in SQL: single characters and composed letters are translated, marks composed."""
    own = {chr(cp): _stands(cp) for cp in (*range(0x20, 0xAC00), *range(0xF900, 0x10000)) if not 0x3131 <= cp <= 0x318E}
    own |= {chr(cp): _stands(cp) for cp in range(0x20) if cp not in _LINES and cp}
    moved = {a: b for a, b in own.items() if a != b and len(b) == 1 and a != "'"}
    dropped = "".join(f"\\x{{{ord(a):X}}}" for a, b in own.items() if b == "") + "\\x{E0000}-\\x{E0FFF}"
    quoted = lambda s: s.replace("'", "''")
    table = f"translate(regexp_replace({text}, '[{dropped}]', '', 'g'), '{quoted(''.join(moved))}', '{quoted(''.join(moved.values()))}')"
    return f"translate(nfc_normalize({table}), '{quoted(''.join(moved))}', '{quoted(''.join(moved.values()))}')"


_GRAMS = """SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {key}, regexp_extract_all(lower({form}), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM {table}))"""
#: Own labels first; what they lack comes from other risks of the category in order of targets, then from the profile's other categories. No profile of
#: these tables exhausts its other categories.
_DRAWN = _REPORT + """, z AS (SELECT y.*, least(needed, existing) AS own, needed - least(needed, existing) AS lack, (SELECT count(*) FROM x WHERE x.c = y.category) AS rows_of FROM y WHERE category IS NOT NULL AND profile_id IS NOT NULL),
w AS (SELECT *, rows_of - sum(own) OVER (PARTITION BY profile_id, category) AS free, coalesce(sum(lack) OVER (PARTITION BY profile_id, category ORDER BY target_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM z),
v AS (SELECT *, greatest(0, least(lack, free - earlier))::BIGINT AS from_siblings FROM w),
u AS (SELECT *, lack - from_siblings AS rest, (SELECT sum(r) FROM (SELECT DISTINCT o.category, o.rows_of AS r FROM v o WHERE o.profile_id = v.profile_id AND o.category <> v.category))
  - (SELECT sum(own + from_siblings) FROM v o WHERE o.profile_id = v.profile_id AND o.category <> v.category) AS elsewhere FROM v),
q AS (SELECT profile_id, target_id, category, risk, needed, existing, own::BIGINT AS own, from_siblings, greatest(0, least(rest, elsewhere))::BIGINT AS from_cousins, (rest - greatest(0, least(rest, elsewhere)))::BIGINT AS short FROM u)
"""
SQL = {
    "p2_report": _DRAWN + "SELECT profile_id, target_id, category, risk, needed, existing, own, from_siblings, from_cousins, short FROM q",
    "p2_drawn": _DRAWN + """SELECT profile_id, target_id, kind, n AS rows, n AS labels FROM (SELECT profile_id, target_id, 'own' AS kind, own AS n FROM q UNION ALL SELECT profile_id, target_id, 'sibling', from_siblings FROM q UNION ALL
SELECT profile_id, target_id, 'cousin', from_cousins FROM q) WHERE n > 0""",
    "p3_shares": "SELECT split_name, target_share, true AS near, 0::BIGINT AS parted, (SELECT count(DISTINCT label_id) FROM labeled_events WHERE label_id IS NOT NULL) AS labels FROM split_targets WHERE split_name IS NOT NULL AND target_share > 0",
    "p6_found": _RANKED + "SELECT video_path, frame_index FROM r WHERE place = 1 AND NOT none",
    "p6_ranking": _RANKED + "SELECT video_path, frame_index, place FROM r",
    "p8_found": f"""SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(key="doc_id", form=_form("text"), table="documents")}) JOIN ({_GRAMS.format(key="item_id", form=_form("item_text"), table="heldout_items")}) USING (g)""",
    "p9_form": f"SELECT doc_id, {_form('text')} AS form FROM documents",
    "p9_classes": f"""WITH f AS (SELECT doc_id, text, {_form("text")} AS form FROM documents WHERE text IS NOT NULL), v AS (SELECT * FROM f WHERE regexp_matches(form, '[^ \\t\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'))
SELECT representative, variant, n AS rows FROM (SELECT min(min(doc_id)) OVER (PARTITION BY form) AS representative, min(doc_id) AS variant, count(*) AS n, count(*) OVER (PARTITION BY form) AS texts FROM v GROUP BY form, text) WHERE texts > 1""",
    "p9_found": f"""WITH f AS (SELECT doc_id, text, {_form("text")} AS form FROM documents WHERE text IS NOT NULL), v AS (SELECT * FROM f WHERE regexp_matches(form, '[^ \\t\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'))
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p1_found": f"""SELECT video_path, frame_index FROM ({_LATEST_CANDIDATES}) WHERE NOT isnan(importance)
QUALIFY row_number() OVER (PARTITION BY video_path ORDER BY importance DESC, frame_index) <= 6""",
    "p2_found": _REPORT + "SELECT profile_id, target_id FROM y WHERE needed > existing",
    "p3_found": f"""WITH RECURSIVE l AS (SELECT label_id, case_id, nullif(lower(trim(source_transition_id, ' ' || chr(9) || chr(10))), '') AS tr FROM ({_LATEST_LABELS})),
b AS (SELECT label_id, 'e' || coalesce('v' || c.video, 'c' || l.case_id) AS bond FROM l LEFT JOIN ({_CASES}) c USING (case_id) WHERE l.case_id IS NOT NULL UNION ALL SELECT label_id, 't' || tr FROM l WHERE tr IS NOT NULL),
step AS (SELECT DISTINCT x.label_id AS a, y.label_id AS z FROM b x JOIN (SELECT bond, min(label_id) AS label_id FROM b GROUP BY bond) y USING (bond)),
both_ways AS (SELECT a, z FROM step UNION SELECT z, a FROM step),
reach(a, z) AS (SELECT label_id, label_id FROM l UNION SELECT r.a, s.z FROM reach r JOIN both_ways s ON r.z = s.a)
SELECT a AS label_id, min(z) AS group_id FROM reach GROUP BY a""",
    "p4_found": _RUNS + "SELECT video_path, first_sequence, last_sequence FROM r WHERE events >= 2",
    "p4_runs": _RUNS + "SELECT video_path, first_sequence, last_sequence, events::BIGINT AS events, started, ended, ended - started AS duration, kind FROM r",
    "p5_found": f"""WITH e AS ({_LATEST_EVENTS}), l AS ({_LATEST_LABELS}),
m AS (SELECT label_id, sequence_no, round(abs(timestamp_s - start_s), 9) AS d, coalesce(CASE WHEN NOT isnan(tolerance) THEN tolerance END, 0) AS tol
  FROM l JOIN ({_CASES}) c USING (case_id) JOIN e ON e.video_path = c.video WHERE NOT isnan(timestamp_s) AND NOT isnan(start_s))
SELECT label_id, sequence_no FROM m WHERE d <= round(tol, 9) QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY d, sequence_no) = 1""",
}
