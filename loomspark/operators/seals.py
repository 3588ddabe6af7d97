"""Sealing of a tail into a band: plan, optimistic commit, snapshot, verification and restore, as rules over sessions.

A state is one row a session: view (frozen text), raw_count (messages it stands for) and bands. A tail
that would not shrink by a tenth is not sealed. A plan carries digests of the state it was made on, and
is committed only on a state that still has them. A snapshot carries its own digest and fails closed.
"""

from __future__ import annotations

#: From (view, raw_count, history_count, raw_tail, folded_tail): what sealing the tail would do.
PLAN = [
    {"tail_chars": "CASE WHEN history_count > coalesce(raw_count, 0) THEN length(coalesce(raw_tail, '')) ELSE 0 END", "band_chars": "length(coalesce(folded_tail, ''))", "prefix_chars": "length(coalesce(view, ''))"},
    {"saved": "tail_chars - band_chars", "ratio": "CASE WHEN tail_chars > 0 THEN round(CAST(band_chars AS DOUBLE) / tail_chars, 9) END"},
    {"skip": "CASE WHEN view IS NULL THEN 'missing-frozen-view' WHEN history_count < raw_count THEN 'history-rewound' WHEN tail_chars <= 0 THEN 'empty-tail' WHEN saved <= 0 OR ratio > 0.9 THEN 'not-smaller' END"},
    {
        "next_view": "CASE WHEN skip IS NULL THEN view || chr(10) || folded_tail ELSE view END",
        "base_digest": "digest(coalesce(view, ''))",
        "next_count": "CASE WHEN skip IS NULL THEN history_count ELSE raw_count END",
        "alarm": "coalesce(ratio > 0.6, FALSE)",
    },
    {"next_digest": "digest(coalesce(next_view, ''))", "next_chars": "length(coalesce(next_view, ''))"},
]

#: From a plan and the state now (now_view, now_count): committed, or a conflict that changes nothing.
COMMIT = [
    {"now_digest": "digest(coalesce(now_view, ''))"},
    {"outcome": "CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN now_digest <> base_digest OR now_count <> raw_count THEN 'conflict' ELSE 'committed' END"},
    {"final_digest": "CASE WHEN outcome = 'committed' THEN next_digest ELSE now_digest END", "final_count": "CASE WHEN outcome = 'committed' THEN next_count ELSE now_count END"},
]

#: From a committed state (session, next_view, next_chars, next_count, band_chars, prefix_chars, skip): the snapshot's manifest.
SNAPSHOT = [
    {"manifest": "'2|' || CAST(next_count AS VARCHAR(20)) || '|' || CAST(next_chars AS VARCHAR(20)) || '|' || CAST(CASE WHEN skip IS NULL THEN band_chars ELSE 0 END AS VARCHAR(20)) || '|' || next_digest"},
    {"manifest_digest": "digest(manifest)"},
]

#: From a stored snapshot (version, stored_view, stored_chars, stored_seed, stored_manifest, stored_manifest_digest, layout): why it
#: may not be restored. The first rule that fails is the reason; a view that is absent needs empty geometry.
VERIFY = [
    {"view_chars": "length(coalesce(stored_view, ''))", "view_digest": "digest(coalesce(stored_view, ''))"},
    {
        "failure": "CASE WHEN version NOT IN (1, 2) THEN 'snapshot-version-unsupported' WHEN stored_chars < 0 THEN 'snapshot-malformed' "
        "WHEN stored_view IS NULL AND stored_chars <> 0 THEN 'sealed-band-layout-invalid' WHEN stored_view IS NULL THEN NULL "
        "WHEN version <> 2 OR stored_manifest_digest IS NULL OR stored_seed IS NULL THEN 'missing-integrity-metadata' WHEN digest(stored_manifest) <> stored_manifest_digest THEN 'integrity-manifest-digest-mismatch' "
        "WHEN view_chars <> stored_chars THEN 'frozen-view-char-mismatch' WHEN layout < 0 OR layout > stored_chars THEN 'sealed-band-layout-invalid' WHEN view_digest <> stored_seed THEN 'seed-base-digest-mismatch' END"
    },
    {"restored": "failure IS NULL", "restored_view_chars": "CASE WHEN failure IS NULL THEN view_chars ELSE 0 END"},
]
