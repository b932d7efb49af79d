"""Result schema of every query (written by `python tests/oracle.py --schemas`)."""
SCHEMAS: dict[str, str] = {
    "prj1_browse_submissions": "submission_id bigint, merchant_id string, day string, source string, claimed_name string, verdict string, final_score double, attack_pattern string",
    "prj2_submission_detail": "submission_id bigint, merchant_id string, day string, label string, external_ref string, verdict string, final_score double, abstained boolean",
    "prj3_audit_stream": "id bigint, submission_id bigint, event string, day string",
    "prj4_sweep_candidates": "submission_id bigint, previous_verdict string, previous_score double",
    "prj5_effective_policy": "merchant_id string, min_risk_for_reject double, min_risk_for_review double, require_liveness boolean, require_id_document boolean, require_behavioral boolean, abstain_band double, webhook_min_score double, audit_retention_days int, avg_fraud_loss_inr double, merchant_ltv_inr double, false_reject_abandon_prob double",
    "prj7_clamp_and_status": "status string, n bigint, total_score double, total_confidence double",
    "prj9_fusion_features": "submission_id bigint, selfie_deepfake_score double, selfie_deepfake_conf double, liveness_video_score double, liveness_video_conf double, id_forensics_score double, id_forensics_conf double, face_match_score double, face_match_conf double, metadata_exif_score double, metadata_exif_conf double",
    "prj11_fixture_manifest": "submission_id bigint, name string, label string, attack_type string, last_verdict string, last_score double, n_real bigint, n_fake bigint",
    "jn1_submission_verdict": "merchant_id string, verdict string, n bigint, mean_score double",
    "jn2_graph_nodes": "submission_id bigint, merchant_id string, claimed_name string, verdict string, final_score double, generator_guess string",
    "jn3_undecided": "submission_id bigint, final_score double",
    "jn11_verdict_diff": "submission_id bigint, new_verdict string, new_score double, previous_verdict string, previous_score double, newly_flagged boolean",
    "ag6_sweep_summary": "scanned bigint, newly_flagged bigint",
    "jn10_telemetry_attach": "token bigint, submission_id bigint, event_count bigint, telemetry_present boolean",
    "jn12_red_team_unused": "picked bigint, already_used int",
    "jn16_neighbour_feed": "submission_id bigint, day string",
    "ag1_attack_gallery": "pattern string, count bigint, mean_score double, merchants string, label string",
    "ag1_gallery_generators": "pattern string, generator_guess string, n bigint",
    "ag1_gallery_samples": "pattern string, rn int, submission_id bigint, final_score double",
    "ag2_live_stats": "total bigint, n_pass bigint, n_review bigint, n_reject bigint, abstention_rate double, latency_p50 double, latency_p90 double, latency_p99 double, latency_mean double, latency_max double, score_d0 double, score_d1 double, score_d2 double, score_d3 double, score_d4 double, score_d5 double, score_d6 double, score_d7 double, score_d8 double, score_d9 double, score_d10 double",
    "ag2_pattern_totals": "attack_pattern string, n bigint",
    "ag3_latency_histogram": "bin int, n bigint, from_ms double",
    "ag4_review_agreement": "decisions bigint, agreement_rate double, n_approve bigint, n_reject bigint, n_escalate bigint",
    "ag5_scoreboard": "merchant_id string, total bigint, fakes_caught bigint, fakes_total bigint, reals_passed bigint, reals_reviewed bigint, reals_rejected bigint, reals_total bigint, mean_latency_ms double, detection_rate double, false_accept_rate double, false_reject_rate double, accuracy double",
    "ag7_pattern_counts": "pattern string, n bigint",
    "ag7_generator_counts": "generator_guess string, n bigint",
    "ag7_merchants_hit": "merchants bigint",
    "ag31_status_counts": "field string, value string, n bigint",
    "tk1_review_queue": "submission_id bigint, merchant_id string, claimed_name string, final_score double, abstained boolean, attack_pattern string",
    "snk5_alert_rows": "submission_id bigint, merchant_id string, final_score double",
    "snk6_decisions": "submission_id bigint, status string",
    "sc20_ceiling": "merchant_id string, ceiling double",
    "sc24_decide": "submission_id bigint, verdict string, abstained boolean",
    "ag9_confusion_rates": "lang string, tp bigint, fp bigint, fn bigint, tn bigint, precision double, recall double, f1 double, false_accept_rate double, false_reject_rate double, accuracy double",
    "ag10_auc": "lang string, n_neg bigint, n_pos bigint, auc double",
    "ag10_auc_lineitem": "l_linestatus string, n_neg bigint, n_pos bigint, auc double",
    "ag11_average_precision": "n bigint, n_pos bigint, ap double",
    "wn9_cumulative_roc": "source string, threshold double, fpr double, tpr double",
    "ag12_roc_points": "vertex bigint, threshold double, fpr double, tpr double",
    "ag33_roc_on_grid": "source string, fpr_at_most double, tpr double",
    "ag13_per_detector": "detector string, rows bigint, coverage double, errors bigint, skipped bigint, mean_genuine double, mean_fraud double, auc_all double, auc_ran double, auc_target double",
    "ag14_per_attack": "attack_type string, n bigint, mean_score double, caught_at_review double, caught_at_reject double, auc_vs_control double",
    "ag15_per_capture": "capture_mode string, n bigint, id_forensics_auc double, tamper_only_auc double, fusion_auc double",
    "ag16_bias_audit": "bucket string, n bigint, auc double, false_reject_rate double, false_accept_rate double, mean_genuine double",
    "sc29_tone_bucket": "bucket string, n bigint",
    "ag17_latency_report": "status string, n bigint, mean double, lowest double, highest double, p50 double, p90 double, p99 double",
    "ag17_per_detector_median": "detector string, median double",
    "ag18_leak_audit": "field string, value string, genuine bigint, fraud bigint, p_fraud double, one_sided boolean, only_class string, expected boolean, share_of_corpus double",
    "ag19_balance_gate": "field string, value string, complaint string",
    "ag20_leak_view": "field string, leaks bigint, expected_one_sided bigint, clean boolean, share_of_corpus double, corpus_clean boolean",
    "ag21_cost_curve": "threshold double, tp bigint, fp bigint, fn bigint, tn bigint, false_accept_rate double, false_reject_rate double, fraud_prevented double, fraud_leaked double, friction_cost double, net_benefit double",
    "ag21_cost_optimum": "threshold double, tp bigint, fp bigint, fn bigint, tn bigint, false_accept_rate double, false_reject_rate double, fraud_prevented double, fraud_leaked double, friction_cost double, net_benefit double",
    "ag32_profitable_range": "lowest double, highest double, points bigint",
    "ag22_family_report": "family string, n bigint, mean_fake double, recall_40 double, recall_50 double, recall_75 double, auc_vs_control double, n_real bigint, mean_real double, fpr_40 double, fpr_50 double, fpr_75 double",
    "ag23_family_headline": "worst_family string, worst_auc double, best_family string, best_auc double, spread double",
    "ag24_group_shortcut": "capture_mode string, std double, share_40 double, share_50 double, share_75 double, n bigint, mean double, median double, p90 double",
    "ag24_confound_share": "frame_auc double, face_auc double, explained double",
    "ag25_signal_auc": "signal string, n_neg bigint, n_pos bigint, auc double",
    "ag25_method_auc": "method string, n bigint, mean_score double, auc_vs_control double",
    "jn13_region_hits": "doc_id bigint, hit boolean, best_iou double",
    "sc28_iou": "i int, mean_iou double",
    "sc31_describe_region": "where_ string, n bigint",
    "ag26_tamper_report": "slice string, value string, n bigint, false_flag_rate double, localised_rate double, mean_best_iou double, layout_flag_rate double, recall_30 double, recall_45 double, recall_60 double, fpr_30 double, fpr_45 double, fpr_60 double, detector_auc double, tamper_auc double",
    "ag27_distribution": "l_returnflag string, n bigint, mean double, lowest double, highest double, p05 double, p50 double, p95 double, p99 double, p9999 double",
    "ag28_model_leaderboard": "model string, kind string, mean_real double, mean_fake double, ms_per_item double, auc double, selected boolean, near_chance boolean",
    "ag29_region_z": "attack string, n bigint, mean_inside double, mean_outside double, mean_difference double, share_hotter double, median_peak double",
    "ag30_layout_consistency": "doc_id bigint, checked boolean, word_count bigint, height_cv double, left_spread double, mean_conf double, layout_score double",
    "tk2_threshold_at_far": "threshold double, far double, accepted bigint, resolved boolean, total bigint",
    "cal1_best_threshold": "threshold double, accuracy double",
    "cal2_rate_at_far": "threshold double, far double, tar double",
    "cal2_score_threshold": "fold int, tar double, far double, accuracy double",
    "cal3_youden_split": "threshold double, j double",
    "cal4_kfold_threshold": "fold int, threshold double, accuracy double, tar double, far double",
    "cal4_kfold_summary": "mean_accuracy double, std_accuracy double, mean_threshold double, std_threshold double",
    "sc27_per_applicant": "l_discount double, n int, rate double, far double",
    "cal7_face_band": "low double, high double, n_genuine bigint, n_mismatch bigint",
    "cal7_keep_better_low": "low double, high double, corpus_fitted_low double",
    "cal8_threshold_for_fpr": "threshold double",
    "cal9_policy_curve": "threshold double, recall double, fpr double, net_benefit double",
    "cal9_fit_policy_thresholds": "reject double, review double, fpr_at_reject double, recall_at_reject double",
    "cal10_transfer_check": "reject double, out_of_fold_fpr double, held_out_fpr double, optimism double, deployable boolean",
    "cal10_naive_comparison": "threshold double, claimed_fpr double, identity_disjoint_fpr double",
    "tk3_round_robin": "l_returnflag string, n int",
    "tk4_pick_disjoint": "picked int, from_taken int",
    "tk5_balance": "label string, method string, n bigint",
    "tk6_cap_imbalance": "y int, n bigint",
    "tk7_spaced_subsample": "event_id bigint",
    "tk8_one_per_identity": "identity bigint, photo bigint, price double",
    "so1_paired_keys": "paired boolean, n bigint",
    "so3_union_populations": "pop string, n bigint, mean double",
    "so4_report_availability": "name string, available boolean",
    "src8_labelled_balanced": "toxic int, n bigint",
    "sp1_identity_split": "split string, n bigint",
    "sp2_subject_split": "label bigint, held_subjects bigint, subjects bigint",
    "sp3_stratified_folds": "y int, fold int, n bigint",
    "sp3_group_folds": "fold int, rows bigint, groups bigint",
    "wn10_cmu_sessionise": "subject bigint, session bigint, rows bigint",
    "wn11_aalto_sessionise": "subject bigint, session int, sections bigint, keys bigint",
    "jn4_face_links": "submission_id bigint, rank int, other_id bigint, similarity double, other_name string, other_merchant string, name_comparable boolean, name_differs boolean",
    "jn4_face_links_shipped_threshold": "submission_id bigint, rank int, other_id bigint, similarity double, other_name string, other_merchant string, name_comparable boolean, name_differs boolean",
    "jn4_face_links_prior": "submission_id bigint, rank int, other_id bigint, similarity double, name_differs boolean",
    "jn5_asset_links_exact": "submission_id bigint, other_id bigint, kind string, n_others bigint, match string, hamming int",
    "jn6_asset_links_near": "submission_id bigint, other_id bigint, kind string, match string, hamming int",
    "jn6_near_vector_fingerprints": "a bigint, b bigint, hamming int",
    "sc15_hamming64": "hamming int, n bigint",
    "sc14_cosine": "vec_id bigint, cosine double",
    "sc16_name_norm": "names bigint",
    "jn7_best_asset_links": "submission_id bigint, other_id bigint, rank int, match string, hamming int, kind string",
    "jn8_graph_face_edges": "source bigint, target bigint, kind string, weight double, name_differs boolean",
    "jn9_graph_asset_edges": "source bigint, target bigint, kind string, weight double, name_differs boolean, members bigint",
    "jn9_asset_pair_counts": "kind string, pairs bigint",
    "jn15_ring_siblings": "submission_id bigint, content_hash string, shared_selfie_with bigint, n_other_names bigint",
    "jn15_ring_names": "content_hash string, claimed_name string, copies bigint",
    "so2_strongest_edges": "source bigint, target bigint, kind string, weight double, name_differs boolean",
    "gr1_connected_components": "id bigint, root bigint, ring bigint",
    "gr2_threat_graph_rings": "ring bigint, size bigint, distinct_names bigint, max_score double, merchants string, has_exact_asset_reuse boolean",
    "ag8_ring_summary": "ring bigint, size bigint, distinct_names bigint, max_score double, merchants string, has_exact_asset_reuse boolean",
    "jn17_face_match_pair": "submission_id bigint, similarity double, direction string, score double, confidence double",
    "jn18_live_match": "event_id bigint, match boolean, margin double, confidence string",
    "sc22_heuristic_fuse": "submission_id bigint, fused double",
    "sc19_linkage_signal": "submission_id bigint, n_face bigint, n_conflict bigint, n_exact bigint, n_near bigint, link_score double, link_exact boolean",
    "sc21_behavioral_channel": "submission_id bigint, channel double",
    "sc23_final_score": "submission_id bigint, final_score double, verdict string, abstained boolean, link_score double, link_exact boolean",
    "sc25_classify_attack": "attack_pattern string, verdict string, n bigint",
    "flagship_ring_decisions": "submission_id bigint, merchant_id string, ring bigint, final_score double, verdict string, abstained boolean, attack_pattern string, link_score double",
    "cal5_impostor_summary": "pairs bigint, mean double, p99 double, p99_99 double, highest double",
    "cal6_linkage_threshold": "pairs bigint, required_far double, resolved boolean, threshold double, accepted bigint, far double",
    "cal6_linkage_grades": "name string, threshold double, pairs bigint, accepted bigint, far double, tar double, per_applicant_20 double, per_applicant_100 double, per_applicant_500 double, per_applicant_1000 double, per_applicant_5000 double, per_applicant_50000 double",
    "wn1_flights": "session bigint, pos bigint, down double, flight double",
    "wn2_pointer_segments": "session bigint, t double, pos bigint, dx double, dy double, length double, dt double",
    "wn3_field_revisits": "session bigint, fields_touched bigint, field_revisits bigint, field_order_monotonic double, field_dwell_cv double",
    "fe1_keystroke_features": "session bigint, n_keys bigint, backspaces bigint, printable bigint, span_s double, dwell_mean double, dwell_std double, dwell_cv double, dwell_median double, dwell_p10 double, dwell_p90 double, dwell_min double, dwell_max double, dwell_iqr double, dwell_unique_ratio double, flight_mean double, flight_std double, flight_cv double, flight_median double, flight_p10 double, flight_p90 double, flight_min double, flight_max double, flight_iqr double, flight_unique_ratio double, rollover_rate double, pause_rate double, dwell_flight_corr double, typing_speed_cps double, backspace_rate double, dwell_samples bigint, dwell_mean_ms double, serve_dwell_cv double, flight_samples bigint, flight_mean_ms double, serve_flight_cv double, flight_min_ms double",
    "fe2_session_basics": "session bigint, keystroke_count bigint, dwell_samples bigint, dwell_mean_ms double, dwell_cv double, flight_samples bigint, flight_mean_ms double, flight_cv double, flight_min_ms double, backspace_rate double, typing_speed_cps double, rollover_rate double",
    "fe3_pointer_features": "session bigint, mouse_points bigint, mouse_straightness double, mouse_path_entropy double, mouse_moving_segments bigint, mouse_dt_samples bigint, mouse_dt_cv double, mouse_jerk_cv double",
    "fe4_form_features": "session bigint, total_time_s double, near_round_sleep_s double, paste_count bigint, paste_into_sensitive bigint, fields_touched bigint, field_revisits bigint, field_order_monotonic double, field_dwell_cv double",
    "sc17_locale_incoherent": "session bigint, locale_incoherent int",
    "sc18_automation_flags": "session bigint, flags string",
    "fe5_behavioral_rules": "session bigint, rules string, score double, confidence double",
    "prj12_session_readback": "session bigint, rules string, score double",
    "fe6_reference_bands": "session bigint, feature string, low double, high double, measured double",
    "sc1_find_pan": "doc_id bigint, pan string",
    "sc3_find_aadhaar": "doc_id bigint, aadhaar string",
    "sc4_find_dob": "doc_id bigint, dob string",
    "sc2_normalise_pan": "c_custkey bigint, fixed string",
    "sc5_validate_pan": "c_custkey bigint, format_ok boolean, holder_type_ok boolean, surname_initial_ok boolean, n_issues int",
    "sc6_verhoeff": "c_custkey bigint, full_number string, full_ok boolean, other_ok boolean",
    "sc7_id_field_score": "c_custkey bigint, score double",
    "sc8_id_forensics_score": "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, score double, confidence double",
    "sc9_selfie_score": "event_id bigint, score double, confidence double",
    "sc10_spectral_heuristic": "event_id bigint, p double",
    "sc30_generator_guess": "event_id bigint, guess string",
    "sc12_metadata_rules": "id bigint, rules string, weight double",
    "sc13_noisy_or": "id bigint, score double, confidence double",
    "wn4_reason_rank": "submission_id bigint, rank int, weight double, reason string",
    "wn5_identity_drift": "clip int, identity_drift double, min_similarity double",
    "wn6_pose_jitter": "clip bigint, pose_jitter double, roll_range double",
    "wn7_flow_spike": "clip bigint, flow_spike double",
    "wn8_blink_count": "clip bigint, blinks bigint",
    "sc11_liveness_score": "clip bigint, score double, confidence double",
    "prj10_dig_json": "user_id bigint, total bigint",
    "prj6_json_safe": "event_type string, n bigint, finite bigint",
    "ud1_registered_detectors": "detector string, status string, n bigint, score double",
    "ud2_registered_rule": "lucky boolean, n bigint, hits bigint",
    "ud4_sql_functions": "c_custkey bigint, shape_ok boolean, checksum_ok boolean, verdict string",
    "ml8_check_claims": "claim string, found double, holds boolean",
    "st1_telemetry_ingest": "token bigint, event_type string, value double",
    "st2_telemetry_sessions": "token bigint, event_count bigint, dwell_mean_ms double, dwell_cv double, paste_count bigint",
    "st3_stream_attach": "submission_id bigint, telemetry_id bigint",
    "st4_running_scoreboard": "total bigint, fakes_caught bigint, fakes_total bigint, reals_passed bigint, reals_reviewed bigint, reals_rejected bigint, reals_total bigint, mean_latency_ms double, detection_rate double, false_accept_rate double, false_reject_rate double, accuracy double",
    "st5_attack_wave": "day string, pattern string, n bigint",
    "st5_attack_wave_sliding": "hour string, pattern string, n bigint",
    "st6_alerts": "submission_id bigint, merchant_id string, final_score double",
    "st7_stream_asset_links": "submission_id bigint, kind string, n_earlier bigint, first_submission bigint",
    "snk1_write_verdicts": "submission_id bigint, verdict string",
    "snk2_write_biometrics": "kind string, n bigint, submissions bigint",
    "snk3_append_audit": "decision boolean, n bigint",
    "snk4_write_report": "event_type string, mean double",
    "src1_read_scores": "n bigint, y bigint, mean double",
    "src2_read_sessions": "sessions bigint, keys bigint, bad bigint",
    "src6_load_policy": "merchant_id string, min_risk_for_reject double, min_risk_for_review double, require_liveness boolean",
    "src9_hash_assets": "files bigint, contents bigint",
    "cal5_genuine_summary": "n bigint, mean double, p05 double, p50 double",
    "jn9_file_relation": "source bigint, target bigint, file_kind string",
    "jn4_face_links_approx_recall": "exact_pairs bigint, invented bigint, recall_reached boolean",
    "ml1_train_fusion": "fit string, rows bigint, converged boolean",
    "ml1_held_out_auc": "n_neg bigint, n_pos bigint, explains boolean",
    "ml2_platt_calibration": "n bigint, positives bigint, mean_kept boolean, rising boolean",
    "ml3_score_fusion": "id bigint, y int, scored boolean",
    "ml3_heuristic_fallback": "id bigint, fusion string, fused double",
    "ml4_ablation": "detector string, matters boolean",
    "ml5_protocols": "features string, protocol string, held_out string, n bigint, within_budget boolean",
    "ml5_penalty_sweep": "config bigint, rows bigint, converged boolean",
    "sp4_leave_one_group_out": "strategy string, n_train bigint, n_test bigint",
    "jn14_score_identity_join": "id bigint, split string, identity bigint, capture string, folded boolean, fold_kind string",
    "jn14_row_fallback": "split string, fold_kind string, n bigint, known bigint",
    "ml6_spectral_head": "n_neg bigint, n_pos bigint, converged boolean, fits boolean",
    "ml6_fingerprint_head": "generator string, n bigint, above_chance boolean",
    "ml7_out_of_fold": "n_neg bigint, n_pos bigint, explains boolean",
    "st2_event_sessions": "session string, keystroke_count bigint, dwell_samples bigint, dwell_mean_ms double, dwell_cv double, flight_samples bigint, flight_mean_ms double, flight_cv double, flight_min_ms double, backspace_rate double, typing_speed_cps double, rollover_rate double",
    "ag26_tamper_by_attack": "attack string, n bigint, detector_auc double, mean_tamper double, localised_rate double, mean_best_iou double, tamper_auc double",
    "ag20_ranked_detectors": "detector string, auc_drop double, rank int, harmful boolean",
    "tk1_detector_summary": "submission_id bigint, detector string, score double, status string",
    "tk1_shared_selfies": "submission_id bigint, shared_selfie_with bigint, n_other_names bigint",
    "src4_read_cmu_wide": "subject string, session_index int, rep int, n_dwells int, dwell_sum double, flight double, n_keys int",
    "src7_read_tables": "name string, n bigint, values bigint",
}
