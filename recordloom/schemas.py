"""Tables of the record store."""

from __future__ import annotations

#: Columns of each table in DDL.
SCHEMAS = {
    "documents": (
        "document_id string, original_filename string, storage_key string, content_type string, file_size int, file_hash string, status string, detected_language string, "
        "description string, document_type string, task_id string, error_message string, page_count int, ocr_confidence double, processing_metadata variant, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "document_pages": (
        "page_id string, document_id string, page_number int, raw_text string, language string, ocr_confidence double, ocr_engine string, "
        "blocks array<struct<text:string, bbox:array<double>, confidence:double, language:string, engine:string>>, preprocessing_info variant, created_at timestamp_ntz"
    ),
    "document_results": (
        "result_id string, document_id string, seq int, field_name string, field_value string, normalized_value string, data_type string, page_number int, bounding_box array<double>, source_text string, "
        "extraction_method string, canonical_key string, original_text string, normalized_text string, transliteration string, translation string, confidence double, validated boolean, "
        "validation_status string, anomaly_flag boolean, anomaly_reason string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "land_records_reference": (
        "ref_id string, survey_number string, khasra_number string, khata_number string, plot_number string, registration_number string, mutation_number string, owner_name string, father_name string, village string, "
        "tehsil string, district string, state string, area string, land_classification string, ring array<struct<x:double, y:double>>, lat double, lng double, lrms_id string, dilrmp_id string, source_database string"
    ),
    "validation_results": (
        "document_id string, field_result_id string, field_name string, confidence_score double, confidence_category string, validation_passed boolean, validation_errors array<string>, verification_status string, "
        "reference_value string, verification_source string, anomaly_detected boolean, anomaly_details string, is_duplicate_flag boolean"
    ),
    "training_samples": (
        "document_id string, field_result_id string, seq long, field_name string, canonical_key string, original_value string, corrected_value string, correction_type string, document_type string, language string, "
        "ocr_confidence double, extraction_method string, dataset_version int, used_in_training boolean, created_at timestamp_ntz"
    ),
    "learning_snapshots": ("version int, training_samples_count int, patterns string, accuracy_before double, accuracy_after double, improvement_delta double, deployed boolean"),
    "users": ("username string, email string, full_name string, hashed_password string, role string, is_active boolean, created_at timestamp_ntz, last_login timestamp_ntz"),
    "audit_logs": (
        "user_id string, username string, role string, action string, resource_type string, resource_id string, ip_address string, user_agent string, request_method string, request_path string, details variant, result string, at timestamp_ntz"
    ),
}

DOCUMENT_STATUS = ["UPLOADED", "OCR_PROCESSING", "EXTRACTION", "VALIDATION", "COMPLETED", "VERIFICATION_REQUIRED", "FAILED"]
CORRECTION_TYPES = ["value_correction", "field_added", "field_deleted", "auto_verified"]
