"""The queries of this subpackage and the SQL of those that SQL can express."""

from chainlake.llm import classifiers, decontamination, fingerprints, licenses, line_dedup, mixing, near_dedup, secrets, token_output

QUERIES = {
    f.__name__: f
    for f in (
        token_output.op1_token_output,
        fingerprints.op2_document_fingerprints,
        licenses.op3_license_scan,
        classifiers.op4_quality_classifier,
        mixing.op5_mixing,
        near_dedup.op6_near_dedup,
        secrets.op7_secret_scan,
        line_dedup.op8_line_dedup,
        classifiers.op9_language_id,
        decontamination.op10_decontamination,
    )
}

ORACLE_SQL = {
    "op3_license_scan": licenses.oracle(),
    "op8_line_dedup": line_dedup.ORACLE,
}
