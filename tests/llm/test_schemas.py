"""The columns that each registered query of the subpackage promises."""

import pytest

from gustframe.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op2_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_embedding_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert {c: got.get(c) for c, _ in (x.split() for x in CONTRACTS[name].split(", "))} == dict(x.split() for x in CONTRACTS[name].split(", "))


def test_every_query_has_a_contract_or_a_test():
    assert set(queries.queries()) - set(CONTRACTS) == {"op1_license_scan", "op6_hamming_top_k", "pipeline"}
