"""The expected result of each query, as SQL over the columns of the given tables.

Nothing here reads YAML or the derived texts of the workflows: what a file contains is
known from its row, so levels, options and labels are computed from the row.
"""

from __future__ import annotations

_FILES = """
WITH rows AS (
  SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c,
         CAST(left(o_orderpriority, 1) AS INT) AS p,
         CAST(year(o_orderdate) - 1970 AS VARCHAR) AS y,
         CAST(month(o_orderdate) + 15 AS VARCHAR) AS m,
         CAST(day(o_orderdate) + 10 AS VARCHAR) AS d
  FROM orders
), named AS (
  SELECT *, lower(s) || '-org' AS owner,
         CASE WHEN s = 'O' THEN 'monorepo' ELSE 'cust' || c END AS project,
         CASE p WHEN 1 THEN '.GitHub_Actions' WHEN 2 THEN '.Travis_CI' WHEN 3 THEN '.CircleCI'
                WHEN 4 THEN '.GitLab' ELSE '.GitHub_Actions' END AS service,
         CASE p WHEN 1 THEN '.ci-' WHEN 2 THEN '..travis-' WHEN 3 THEN '.config-'
                WHEN 4 THEN '..gitlab-ci-' ELSE '.test-' END || k
           || CASE WHEN y = '25' THEN '.yml.bak' WHEN p = 4 THEN '.yaml' ELSE '.yml' END AS rest
  FROM rows
), every_file AS (
  SELECT *, owner || '.' || project || service || rest AS name,
         '/corpus/' || s || '/' || owner || '.' || project || service || rest AS path,
         owner || '.' || project || CASE WHEN p IN (3, 4) THEN service || rest ELSE '' END AS prefix
  FROM named
), files AS (
  SELECT *, s <> 'P' AS workflow, s = 'P' AND p IN (1, 5) AS invalid, s = 'P' AND p = 2 AS empty
  FROM every_file WHERE y <> '25'
)
"""

_JSON = """
WITH rows AS (
  SELECT '/json/' || o_orderkey || '.json' AS path, o_orderkey AS k, o_orderstatus AS s,
         CAST(left(o_orderpriority, 1) AS INT) AS p,
         CAST(year(o_orderdate) - 1970 AS VARCHAR) AS y,
         CAST(month(o_orderdate) + 15 AS VARCHAR) AS m,
         CAST(day(o_orderdate) + 10 AS VARCHAR) AS d
  FROM orders
)
"""

_PHRASES = """
WITH words AS (
  SELECT item_id, string_split(text, ' ') AS w FROM benchmark
), rules AS (
  SELECT lpad(CAST(item_id AS VARCHAR), 5, '0') || '-' || lpad(CAST(i AS VARCHAR), 4, '0') AS label,
         array_to_string(list_slice(w, i, i + 5), ' ') AS keyword
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 6)
), hits AS (
  SELECT source, label FROM documents d JOIN rules r ON contains(d.text, r.keyword)
)
"""


def _types(*conditions: tuple[str, str]) -> str:
    """Rendered label set; the conditions are given in the order of their labels."""
    cases = ", ".join(f"CASE WHEN {condition} THEN '{label}' END" for label, condition in conditions)
    return f"coalesce(nullif(concat_ws(', ', {cases}), ''), 'none')"


def _any_types(*labels: str) -> str:
    """The same over a group of rows that hold one rendered set each."""
    return _types(*[(label, f"bool_or(contains(test_types, '{label}'))") for label in labels])


_V1 = _types(
    ("appcenter_test", "workflow AND p = 5"),
    ("browserstack_test", "workflow AND p = 3"),
    ("emulator_ci", "workflow OR p <> 4"),
    ("firebase_test_lab", "p = 4"),
)
_V2_FOLDED = _types(
    ("GitHub_emulator_compact", "workflow AND p = 2 AND s = 'O'"),
    ("GitHub_emulator_full", "workflow AND p = 1"),
    ("GitHub_emulator_manual", "CASE WHEN workflow THEN p = 3 ELSE p IN (2, 3, 5) END"),
    ("GitHub_gradle", "CASE WHEN workflow THEN p = 2 ELSE p = 1 END"),
    ("appcenter_test", "workflow AND p = 5"),
    ("browserstack_test", "workflow AND p = 3"),
    ("firebase_test_lab", "p = 4"),
)
_V2 = _types(
    ("GitHub_emulator_compact", "workflow AND p = 2 AND s = 'O'"),
    ("GitHub_emulator_full", "workflow AND p = 1"),
    ("GitHub_emulator_manual", "NOT workflow AND p IN (3, 5)"),
    ("GitHub_gradle", "CASE WHEN workflow THEN p = 2 ELSE p = 1 END"),
    ("appcenter_test", "workflow AND p = 5"),
    ("browserstack_test", "workflow AND p = 3"),
    ("firebase_test_lab", "p = 4"),
)
_V2_UNFOLDED = _types(
    ("GitHub_emulator_compact", "workflow AND p = 2 AND s = 'O'"),
    ("GitHub_emulator_full", "workflow AND p = 1"),
    ("GitHub_emulator_manual", "NOT workflow AND p IN (3, 5)"),
    ("GitHub_gradle", "NOT workflow AND p = 1"),
    ("appcenter_test", "workflow AND p = 5"),
    ("browserstack_test", "workflow AND p = 3"),
    ("firebase_test_lab", "p = 4"),
)
_LABELS_V1 = ("appcenter_test", "browserstack_test", "emulator_ci", "firebase_test_lab")
_LABELS_V2 = (
    "GitHub_emulator_compact",
    "GitHub_emulator_full",
    "GitHub_emulator_manual",
    "GitHub_gradle",
    "appcenter_test",
    "browserstack_test",
    "firebase_test_lab",
)

# error_kind and surviving labels per report.
_KIND = "CASE WHEN invalid THEN 'yaml' WHEN empty THEN 'empty' END"
_KIND_FIXED = "CASE WHEN invalid THEN 'yaml' END"
_KIND_ROOT = "CASE WHEN invalid THEN 'yaml' WHEN empty THEN 'empty' WHEN s = 'P' AND p = 3 THEN 'root' END"


def _facts(kind: str, types: str, kept: str, project: str = "project") -> str:
    return f"""{_FILES}, facts AS (
      SELECT path, {project} AS project, k, s, p, y, m, d, workflow,
             {kind} AS error_kind, {kind} IS NOT NULL AS error,
             CASE WHEN {kept} THEN {types} ELSE 'none' END AS test_types
      FROM files)"""


_FACTS_V1 = _facts(_KIND, _V1, "NOT invalid AND NOT empty", "prefix")
_FACTS_V2 = _facts(_KIND, _V2, "NOT invalid")
_FACTS_FIXED = _facts(_KIND_FIXED, _V2_FOLDED, "NOT invalid")
_FACTS_ROOT = _facts(_KIND_ROOT, _V2_UNFOLDED, "NOT invalid AND NOT (s = 'P' AND p = 3)")

_FIXED_LEVELS = """, fixed_levels AS (
  SELECT path, project, unnest(CASE
           WHEN s <> 'F' OR p = 3 THEN CAST([] AS VARCHAR[])
           WHEN p = 4 THEN [y, d]
           WHEN p = 5 THEN string_split(d, '')
           ELSE [y, d, 'None'] END) AS api_level
  FROM {source})"""
_OPTIONS = """, options AS (
  SELECT path, project, k, unnest(CASE
           WHEN s <> 'F' THEN CAST([] AS VARCHAR[])
           WHEN p = 1 THEN ['-port ' || k, '-no-window', 'tail']
           WHEN p = 4 THEN ['-port ' || k, '[''a'', 1]', 'tail']
           ELSE ['-port ' || k] END) AS emulator_option
  FROM {source})"""
_TAGGED = """, tagged AS (
  SELECT project, 'matrix' AS source, y AS api_level FROM facts WHERE workflow AND p <= 2
  UNION SELECT project, 'matrix', m FROM facts WHERE workflow AND p <= 2
  UNION SELECT project, 'hardcoded', m FROM facts WHERE workflow AND p > 2
  UNION SELECT project, 'hardcoded', d FROM facts WHERE workflow AND NOT (p <= 2 AND d IN (y, m)))"""


def _join(values: str, order: str) -> str:
    return f"coalesce(string_agg({values}, ',' ORDER BY {order}), '')"


# Characters that open a comment line, after the blanks that may precede it.
_COMMENT = r"^[\t ]*#"
_NOTES = r"""
WITH notes AS (
  SELECT doc_id, source AS project, list_transform(string_split(text, chr(10)),
         lambda l: CASE WHEN regexp_matches(l, '^[AEIOU]') THEN '  # ' || l ELSE l END) AS lines
  FROM documents
), bare AS (
  SELECT doc_id, project, lines,
         list_filter(lines, lambda l: NOT regexp_matches(l, '^[\t ]*#')) AS kept
  FROM notes)
"""


def _prose(text: str, *words: tuple[str, list[str]]) -> str:
    return ", ".join(
        f"bool_or({' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in ws)}) AS {label}"
        for label, ws in words
    )


def _audit(facts: str) -> str:
    return f"{facts} SELECT path, project, test_types, error, error_kind FROM facts"


ORACLE: dict[str, str] = {
    "scan_inventory": f"""{_FILES}
        SELECT CASE WHEN p = 4 THEN 'yaml' ELSE 'yml' END AS suffix, count(*) AS files FROM files GROUP BY 1""",
    "decode_normalise": """
        SELECT doc_id, lang <> 'fr' AS valid, CASE WHEN lang <> 'fr' THEN
               replace(replace(replace(text, '. ', '. ' || chr(10)), ', ', ',' || chr(10)), chr(9), ' ') END AS text
        FROM documents""",
    "project_key_prefix": f"{_FILES} SELECT path, prefix AS project FROM every_file",
    "project_key_positional": f"{_FILES} SELECT path, name, project FROM every_file",
    "strip_comment_lines": f"""{_NOTES}
        SELECT doc_id, array_to_string(
                 CASE WHEN lines[-1] = '' THEN list_slice(kept, 1, len(kept) - 1) ELSE kept END, chr(10)) AS text
        FROM bare""",
    "classify_basic": f"{_FILES} SELECT path, {_V1} AS test_types FROM files",
    "classify_uncommented": f"{_FILES} SELECT path, {_V2} AS test_types FROM files",
    "classify_folded": f"{_FILES} SELECT path, {_V2_FOLDED} AS test_types FROM files",
    "classify_unfolded_keywords": f"{_FILES} SELECT path, {_V2_UNFOLDED} AS test_types FROM files",
    "classify_rules_join": """
        SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""",
    "classify_rules_equi_join": """
        SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""",
    "summary_rule_sets": f"""{_PHRASES}
        SELECT source, CAST(count(DISTINCT label) AS BIGINT) AS n_labels FROM hits GROUP BY 1""",
    "summary_rule_labels": f"""{_PHRASES}
        SELECT source, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM hits GROUP BY 1""",
    "flag_substring": f"{_FILES} SELECT path, workflow AND p = 1 AS uses_matrix FROM files",
    "validate_documents": f"""{_FILES}
        SELECT path, NOT invalid AS ok, empty AS is_empty,
               CASE WHEN invalid THEN NULL WHEN empty THEN 'null' WHEN s = 'P' AND p = 3 THEN 'list'
                    ELSE 'map' END AS root_kind
        FROM files""",
    "config_fields": """
        SELECT p_partkey, p_size AS range_min, CAST(p_size + 100 AS INT) AS range_max, p_size AS guesses,
               CASE p_type WHEN 'SMALL' THEN 'single' WHEN 'ECONOMY' THEN 'multi' ELSE p_brand END AS mode,
               CASE p_type WHEN 'SMALL' THEN 'draw' WHEN 'ECONOMY' THEN 'ask' ELSE 'invalid' END AS branch
        FROM part""",
    "config_document": """
        SELECT p_partkey, 'range' AS key, 'map' AS kind,
               '{''max'': ' || (p_size + 100) || ', ''min'': ' || p_size || '}' AS value FROM part
        UNION ALL SELECT p_partkey, 'guesses', 'int', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 'mode', 'str',
               CASE p_type WHEN 'SMALL' THEN 'single' WHEN 'ECONOMY' THEN 'multi' ELSE p_brand END FROM part""",
    "config_event_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "levels_fixed_path": f"""{_FILES}{_FIXED_LEVELS.format(source='files')},
        per_file AS (SELECT DISTINCT path, api_level FROM fixed_levels)
        SELECT f.path, {_join('api_level', 'api_level')} AS api_levels
        FROM files f LEFT JOIN per_file l ON f.path = l.path GROUP BY 1""",
    "levels_recursive": f"""{_FILES}
        SELECT path,
               CASE WHEN NOT workflow OR p > 2 THEN '' WHEN y = m THEN y
                    ELSE least(y, m) || ',' || greatest(y, m) END AS matrix_levels,
               CASE WHEN NOT workflow THEN '' WHEN d = m THEN d
                    ELSE least(d, m) || ',' || greatest(d, m) END AS hardcoded_levels
        FROM files""",
    "options_extract": f"""{_FILES}{_OPTIONS.format(source='files')}
        SELECT f.path, coalesce(string_agg(emulator_option, '|' ORDER BY
                 CASE WHEN emulator_option = 'tail' THEN 2 WHEN starts_with(emulator_option, '-port') THEN 0 ELSE 1 END), '') AS options
        FROM files f LEFT JOIN options o ON f.path = o.path GROUP BY 1""",
    "options_long": f"""{_FACTS_FIXED}{_OPTIONS.format(source='facts')}
        SELECT project, emulator_option FROM options""",
    "options_in_order": f"""{_FACTS_FIXED}{_OPTIONS.format(source='facts')}
        SELECT project, path, emulator_option,
               CASE WHEN emulator_option = 'tail' THEN 2 WHEN starts_with(emulator_option, '-port') THEN 0 ELSE 1 END
                 AS position FROM options""",
    "options_numbered": f"""{_FACTS_FIXED}{_OPTIONS.format(source='facts')}
        SELECT row_number() OVER (ORDER BY path, CASE WHEN emulator_option = 'tail' THEN 2
                 WHEN starts_with(emulator_option, '-port') THEN 0 ELSE 1 END) - 1 AS number, project, emulator_option
        FROM options""",
    "projects_first_seen": f"""{_FILES}
        SELECT row_number() OVER (ORDER BY path) - 1 AS number, project, path
        FROM (SELECT project, min(path) AS path FROM files GROUP BY 1)""",
    "levels_json_recursive": f"""{_JSON}, found AS (
          SELECT path, 'matrix' AS source, y AS api_level FROM rows WHERE s <> 'P' AND p <= 2
          UNION SELECT path, 'matrix', m FROM rows WHERE s <> 'P' AND p <= 2
          UNION SELECT path, 'hardcoded', m FROM rows WHERE s <> 'P'
          UNION SELECT path, 'hardcoded', d FROM rows WHERE s <> 'P')
        SELECT path, source, api_level FROM found f WHERE source = 'matrix' OR NOT EXISTS (
          SELECT 1 FROM found g WHERE g.path = f.path AND g.api_level = f.api_level AND g.source = 'matrix')""",
    "levels_json_fixed_path": f"""{_JSON}
        SELECT DISTINCT path, api_level FROM (SELECT path, unnest(CASE
           WHEN s <> 'F' OR p = 3 THEN CAST([] AS VARCHAR[]) WHEN p = 4 THEN [y, 'd' || d]
           WHEN p = 5 THEN string_split(d, '') ELSE [y, d, 'None', 'True'] END) AS api_level FROM rows)""",
    "options_json": f"""{_JSON}
        SELECT path, CAST(1 AS INT) AS step, CAST(1 AS INT) AS position, '-port ' || k AS emulator_option
        FROM rows WHERE s = 'F'
        UNION ALL SELECT path, 2, 0, 'False' FROM rows WHERE s = 'F' AND p = 1
        UNION ALL SELECT path, 2, 1, '7' FROM rows WHERE s = 'F' AND p = 1
        UNION ALL SELECT path, 2, 1, 'None' FROM rows WHERE s = 'F' AND p = 3
        UNION ALL SELECT path, 2, 0, '["a",1]' FROM rows WHERE s = 'F' AND p = 4
        UNION ALL SELECT path, 3, 0, 'tail' FROM rows WHERE s = 'F' AND p IN (1, 3, 4)""",
    "levels_long": f"""{_FACTS_FIXED}{_FIXED_LEVELS.format(source='facts')}
        SELECT DISTINCT project, api_level FROM fixed_levels""",
    "levels_tagged": f"{_FACTS_ROOT}{_TAGGED} SELECT project, source, api_level FROM tagged",
    "levels_detailed": f"""{_FACTS_ROOT}{_TAGGED},
        counts AS (SELECT project, count(*) AS yml_count FROM facts GROUP BY 1)
        SELECT project, api_level, source, yml_count FROM tagged JOIN counts USING (project)""",
    "summary_counts": f"""{_FACTS_V2}
        SELECT project, count(*) AS yml_count, count(*) FILTER (error) AS yaml_errors FROM facts GROUP BY 1""",
    "summary_labels": f"""{_NOTES}, low AS (
          SELECT project, lower(array_to_string(kept, chr(10))) AS t FROM bare
        ), flags AS (
          SELECT project, count(*) AS yml_count, {_prose('t', ('l', ['license']), ('q', ['test', 'error']),
          ('a', [' the ', ' los ', ' der ']), ('x', ['token', 'api_key']))} FROM low GROUP BY 1)
        SELECT project, yml_count,
               {_types(('Licensing', 'l'), ('Quality', 'q'), ('articles', 'a'), ('secrets', 'x'))} AS labels
        FROM flags""",
    "summary_labels_unfolded": f"""{_NOTES}, low AS (
          SELECT project, lower(array_to_string(lines, chr(10))) AS t FROM bare
        ), flags AS (
          SELECT project, count(*) AS yml_count, {_prose('t', ('l', ['license']), ('q', ['Test', 'error']),
          ('a', [' the ', ' Los ', ' DER ']), ('x', ['token', 'API_KEY']))} FROM low GROUP BY 1)
        SELECT project, yml_count,
               {_types(('Licensing', 'l'), ('Quality', 'q'), ('articles', 'a'), ('secrets', 'x'))} AS labels
        FROM flags""",
    "summary_levels": f"""{_FACTS_ROOT}{_TAGGED}
        SELECT f.project, CAST(count(DISTINCT t.api_level) FILTER (t.source = 'matrix') AS INT) AS distinct_matrix,
               CAST(count(DISTINCT t.api_level) FILTER (t.source = 'hardcoded') AS INT) AS distinct_hardcoded
        FROM (SELECT DISTINCT project FROM facts) f LEFT JOIN tagged t ON f.project = t.project GROUP BY 1""",
    "summary_flags": f"""{_FACTS_FIXED}
        SELECT project, bool_or(workflow AND p = 1) AS uses_matrix FROM facts GROUP BY 1""",
    "summary_options": f"""{_FACTS_FIXED}{_OPTIONS.format(source='facts')}
        SELECT f.project, count(o.project) > 0 AS has_options, count(o.project) AS options
        FROM facts f LEFT JOIN options o ON f.path = o.path GROUP BY 1""",
    "instrumentation_summary_v1": f"""{_FACTS_V1}
        SELECT project, {_any_types(*_LABELS_V1)} AS test_types, count(*) FILTER (error) AS yaml_errors
        FROM facts GROUP BY 1""",
    "instrumentation_summary_v2": f"""{_FACTS_V2}
        SELECT project, {_any_types(*_LABELS_V2)} AS test_types, count(*) FILTER (error) AS yaml_errors
        FROM facts GROUP BY 1""",
    "project_test_summary": f"""{_FACTS_FIXED}{_FIXED_LEVELS.format(source='facts')}, distinct_levels AS (
          SELECT project, CAST(count(DISTINCT api_level) AS INT) AS n FROM fixed_levels GROUP BY 1)
        SELECT f.project, count(*) AS yml_count, {_any_types(*_LABELS_V2)} AS test_types,
               bool_or(workflow AND p = 1) AS uses_matrix_api_level,
               CAST(coalesce(max(n), 0) AS INT) AS distinct_api_levels, bool_or(s = 'F') AS has_emulator_options
        FROM facts f LEFT JOIN distinct_levels l ON f.project = l.project GROUP BY 1""",
    "project_test_types": f"""{_FACTS_ROOT}{_TAGGED}, counted AS (
          SELECT project, count(*) FILTER (source = 'matrix') AS a, count(*) FILTER (source = 'hardcoded') AS b
          FROM tagged GROUP BY 1)
        SELECT f.project, {_any_types(*_LABELS_V2)} AS test_types,
               CAST(coalesce(max(a), 0) AS INT) AS distinct_matrix_api_levels,
               CAST(coalesce(max(b), 0) AS INT) AS distinct_hardcoded_api_levels,
               count(*) AS yml_count, count(*) FILTER (error) AS yaml_errors
        FROM facts f LEFT JOIN counted c ON f.project = c.project GROUP BY 1""",
    "file_audit_v1": _audit(_FACTS_V1),
    "file_audit_v2": _audit(_FACTS_V2),
    "file_audit_fixed_path": _audit(_FACTS_FIXED),
    "file_audit_provenance": _audit(_FACTS_ROOT),
}
