"""Registry guard: every query stays registered, documented and (where it has one) paired with its oracle."""

import subprocess
import sys

import __spark_entry__ as E

EXPECTED = [
    'accuracy_f1', 'auc_ovr', 'baseline_delta', 'class_distribution',
    'class_distribution_by_split', 'class_names', 'class_order', 'class_weights_balanced',
    'class_weights_sqrt', 'classification_report', 'coerce_numeric', 'compare_models',
    'confusion_matrix', 'correlation_matrix', 'cross_validate', 'csv_contract_scan',
    'distinct_counts', 'duplicate_rows', 'embedding_filter_remap', 'embedding_sample',
    'embedding_standardize', 'embedding_variance_topk', 'engineer_features', 'engineer_features_fixed',
    'evaluate_subset', 'feature_importance', 'feature_search', 'feature_search_nb',
    'filter_remap_classes', 'fold_summary', 'gap_bands', 'grid_search',
    'group_holdout', 'group_kfold', 'histogram_30', 'keep_senders',
    'lineitem_describe', 'lineitem_distinct_counts', 'lineitem_stratified_split', 'one_hot_roundtrip',
    'orders_customer_holdout', 'orders_customer_kfold', 'param_search', 'param_search_cv',
    'parse_records', 'prediction_export', 'prediction_totals', 'preparation_run',
    'preview_topn', 'profile_describe', 'profile_duplicates', 'profile_head',
    'profile_inf', 'profile_info', 'profile_missing', 'random_search',
    'rate_windows', 'regroup_classes', 'repeated_holdout', 'row_weights',
    'run_record', 'scaled_check', 'score_batch', 'score_records',
    'sender_consistency', 'soft_vote', 'split_files', 'split_overlap',
    'standardize', 'stratified_sample', 'stratified_split', 'stream_features',
    'stream_features_event_time', 'stream_scores', 'train_boosted_ovr', 'train_forest',
    'training_run', 'union_splits', 'variance_topk', 'xy_pair_load',
    'zero_variance',
    'auc_fixed_score', 'correlation_missing_values', 'distinct_counts_large_ids', 'fill_missing', 'filter_remap_counts',
    'boosted_stumps', 'engineer_features_cut', 'holdout_search', 'merged_sketches', 'rbf_svm', 'stacking', 'score_batch_nodes', 'score_records_nodes', 'stratified_sample_missing_keys', 'stratified_split_missing_keys', 'stream_scores_nodes',
    'parse_records_large_ids', 'rate_windows_stream', 'stratified_split_missing_labels', 'xy_pair_many_files',
]


def test_no_registered_query_disappears():
    missing = sorted(set(EXPECTED) - set(E.queries()))
    assert not missing, f"queries no longer registered: {missing}"


def test_oracles_pair_with_queries_and_queries_are_documented():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 73
    undocumented = [n for n, f in q.items() if not (f.__doc__ or "").strip() and n not in o]
    assert not undocumented, undocumented


#: An importer that finds no ``beaconflow.llm``, as if the folder were gone.
HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("beaconflow.llm"):
            raise ModuleNotFoundError("No module named 'beaconflow.llm'", name="beaconflow.llm")
sys.meta_path.insert(0, Hide())
import __spark_entry__ as E
print(sum(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in E.queries()), len(E.queries()) > 80)
"""


def test_the_rest_imports_without_the_training_data_operators():
    out = subprocess.run([sys.executable, "-c", HIDDEN], cwd=E.__file__.rsplit("/", 1)[0], capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["0", "True"], out.stderr[-500:]
