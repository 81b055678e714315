"""Tabular data preparation and analysis on Spark DataFrames."""

from tabweave.functions.dates import (datetime_diff, datetime_filter, datetime_range, extract_datetime_parts,
                                      set_datetime_index)
from tabweave.functions.transforms import (bin_column, bin_counts, log_domain_counts, log_transform, normalize,
                                           polynomial_features)
from tabweave.operators.aggregate import crosstab, describe_by_group, group_aggregate, group_aggregate_multi
from tabweave.operators.charts import (bar_counts, box_stats, cumulative, cumulative_marks, density_curve,
                                       distribution_comparison, heatmap, histogram, line_series, pair_bins, qq_line,
                                       qq_points, scatter_bins, stacked_bar, violin_stats)
from tabweave.operators.clustering import (cluster_profile, cluster_sizes, elbow_curve, kmeans_cluster,
                                           silhouette_score)
from tabweave.operators.columns import (apply_mapping, clip_outliers, clip_report, convert_dtype, count_value,
                                        create_column, drop_columns, rename_columns, replace_values, select_dtypes,
                                        string_clean)
from tabweave.operators.correlation import correlation_matrix, get_correlation
from tabweave.operators.density import dbscan_cluster
from tabweave.operators.encode import frequency_encode, label_encode, label_mapping, one_hot_encode, target_encode
from tabweave.operators.hypothesis import (anova_test, chi_square_test, group_medians, kruskal_wallis_test,
                                           mann_whitney_test, normality_test, ttest_independent)
from tabweave.operators.interpret import model_feature_importance, permutation_importance
from tabweave.operators.metrics import (average_precision, classification_metrics, confusion_matrix,
                                        precision_recall_curve, regression_metrics, residual_bins, residual_histogram,
                                        residuals, roc_auc, roc_curve)
from tabweave.operators.missing import fill_missing, missing_counts
from tabweave.operators.modeling import (TrainedModel, compare_models, cross_validate, evaluate_model, grid_search,
                                         learning_curve, list_models, predict, score_summary, train_model,
                                         train_test_split)
from tabweave.operators.profile import (detect_outliers, get_column_profile, get_info, get_shape, get_statistics,
                                        get_unique_values, get_value_counts, missing_patterns, quality_report)
from tabweave.operators.reduction import pca_transform
from tabweave.operators.relational import concat_dataframes, melt_dataframe, merge_dataframes, pivot_table
from tabweave.operators.rows import (add_row_index, drop_duplicates, drop_missing, filter_rows, get_head, get_tail,
                                     sample_data, sort_values)
from tabweave.operators.neighbours import neighbour_information
from tabweave.operators.selection import (correlation_filter, drop_low_importance, feature_importance,
                                          mutual_information, variance_filter)
from tabweave.operators.silhouette import silhouette_euclidean
from tabweave.session import local_session
from tabweave.sources.files import load_csv, load_parquet, save_csv, table_shapes
from tabweave.sources.workbooks import load_excel

__all__ = [name for name in dir() if not name.startswith("_")]
