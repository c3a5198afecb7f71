"""Declared schemas of the estate inputs (FIXTURES.md §1), as DDL strings.

Readers use them instead of schema inference (``spark.read.schema(...)``), and
loaders align drifting feeds to them with ``snapshot.load_with_drift``.
Types follow SURVEY §1.2: ``tinyint`` becomes SMALLINT (the source is
unsigned), times are TIMESTAMP_NTZ, ``sql_variant`` and XML are STRING.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "server_list": "server_name STRING NOT NULL, server_ip_address STRING, monitoring_active BOOLEAN NOT NULL, "
                   "is_sql_server BOOLEAN, is_production BOOLEAN",
    "database_snapshot": "server_name STRING NOT NULL, name STRING NOT NULL, database_id INT, owner_name STRING, "
                         "create_date TIMESTAMP_NTZ, compatibility_level SMALLINT, state_desc STRING, "
                         "recovery_model_desc STRING, is_read_only BOOLEAN, size_mb DECIMAL(10,2), "
                         "space_available_mb DECIMAL(10,2), data_space_mb DECIMAL(10,2), "
                         "index_space_mb DECIMAL(10,2), log_space_mb DECIMAL(10,2), last_backup_date TIMESTAMP_NTZ, "
                         "last_log_backup_date TIMESTAMP_NTZ, data_collection_time TIMESTAMP_NTZ",
    "database_current_extra": "backup_schedule STRING, backup_root_path STRING, backup_n_files SMALLINT, "
                              "backup_batch_no SMALLINT, keep_n_backups SMALLINT, index_maintenance_schedule STRING, "
                              "dbcc_schedule STRING, statistics_maintenance_schedule STRING, row_checksum BIGINT",
    "disk_snapshot": "server_name STRING NOT NULL, drive STRING NOT NULL, vol_name STRING, file_system STRING, "
                     "size_mb BIGINT, free_mb BIGINT, cluster_size INT, data_collection_time TIMESTAMP_NTZ",
    "server_snapshot": "server_name STRING NOT NULL, os STRING, os_architecture STRING, os_patch_level STRING, "
                       "os_version STRING, ip_address STRING, manufacturer STRING, server_model STRING, "
                       "processor_name STRING, power_plan STRING, last_boot_up_time TIMESTAMP_NTZ, "
                       "physical_memory_mb INT, n_cpus INT, is_accessible BOOLEAN, data_collection_time TIMESTAMP_NTZ",
    "service_status": "server_name STRING NOT NULL, display_name STRING NOT NULL, name STRING, state STRING, "
                      "status STRING, start_mode STRING, start_name STRING, data_collection_time TIMESTAMP_NTZ",
    "settings": "server_name STRING NOT NULL, name STRING NOT NULL, value STRING",
    "size_history": "server_name STRING NOT NULL, name STRING NOT NULL, data_collection_time TIMESTAMP_NTZ NOT NULL, "
                    "size_mb DECIMAL(10,2), space_available_mb DECIMAL(10,2), data_space_mb DECIMAL(10,2), "
                    "index_space_mb DECIMAL(10,2), log_space_mb DECIMAL(10,2)",
    "mirror_status": "server_name STRING NOT NULL, database_name STRING NOT NULL, mirroring_role INT, "
                     "mirroring_role_desc STRING, mirroring_state INT, mirroring_state_desc STRING, "
                     "mirroring_witness_state INT, mirroring_witness_state_desc STRING, mirroring_safety_level INT, "
                     "mirroring_safety_level_desc STRING, change_date TIMESTAMP_NTZ",
    "job_last_status": "server_name STRING NOT NULL, job_name STRING, step_id INT, step_name STRING, enabled BOOLEAN, "
                       "owner_name STRING, next_run TIMESTAMP_NTZ, last_run TIMESTAMP_NTZ, last_run_status STRING, "
                       "last_run_duration STRING, data_collection_time TIMESTAMP_NTZ",
    "versions": "product STRING NOT NULL, resource_version STRING NOT NULL, file_version STRING, "
                "description STRING, release_date DATE",
    "weekday_bits": "bit_value SMALLINT NOT NULL, name STRING NOT NULL, day_no SMALLINT NOT NULL",
    "permission_edges": "class_desc STRING NOT NULL, permission_name STRING NOT NULL, covering_permission_name STRING, "
                        "parent_class_desc STRING, parent_covering_permission_name STRING",
    "counter_details": "counter_id INT NOT NULL, machine_name STRING, object_name STRING, counter_name STRING, "
                       "instance_name STRING",
    "counter_data": "counter_id INT NOT NULL, record_index INT, counter_date_time STRING, counter_value DOUBLE",
    "usage_reading": "server_name STRING NOT NULL, database_name STRING NOT NULL, object_id INT NOT NULL, "
                     "index_id INT NOT NULL, index_name STRING, user_seeks BIGINT, user_scans BIGINT, "
                     "user_lookups BIGINT, user_updates BIGINT, system_seeks BIGINT, system_scans BIGINT, "
                     "system_lookups BIGINT, system_updates BIGINT, reading_time TIMESTAMP_NTZ",
    "database_files": "database_id INT NOT NULL, file_id INT NOT NULL, logical_name STRING, type_desc STRING, "
                      "size BIGINT, space_used BIGINT, growth BIGINT, is_percent_growth BOOLEAN, max_size BIGINT, "
                      "physical_name STRING",
    "volumes": "drive STRING NOT NULL, size_mb BIGINT, free_mb BIGINT",
    "io_stats": "database_id INT NOT NULL, file_id INT NOT NULL, num_of_bytes_read BIGINT, size_on_disk_bytes BIGINT",
    "procedure_stats": "database_name STRING, schema_name STRING, object_name STRING, cached_time TIMESTAMP_NTZ, "
                       "last_execution_time TIMESTAMP_NTZ, execution_count BIGINT, total_worker_time BIGINT, "
                       "total_elapsed_time BIGINT, total_logical_reads BIGINT, total_logical_writes BIGINT, "
                       "total_physical_reads BIGINT",
    "runtime_stats": "db STRING NOT NULL, plan_id BIGINT NOT NULL, interval_id BIGINT NOT NULL, "
                     "execution_type_desc STRING, count_executions BIGINT, avg_duration DOUBLE, avg_cpu_time DOUBLE, "
                     "avg_logical_io_reads DOUBLE, avg_physical_io_reads DOUBLE, avg_logical_io_writes DOUBLE, "
                     "avg_query_max_used_memory DOUBLE, avg_rowcount DOUBLE",
    "intervals": "db STRING NOT NULL, interval_id BIGINT NOT NULL, start_time TIMESTAMP, end_time TIMESTAMP",
    "waits": "db STRING NOT NULL, plan_id BIGINT NOT NULL, interval_id BIGINT NOT NULL, wait_category_desc STRING, "
             "total_query_wait_time_ms BIGINT, avg_query_wait_time_ms DOUBLE",
    "indexes": "database_id INT NOT NULL, object_id INT NOT NULL, index_id INT NOT NULL, name STRING, type INT, "
               "type_desc STRING, is_primary_key BOOLEAN, is_unique BOOLEAN, fill_factor SMALLINT",
    "index_columns": "database_id INT NOT NULL, object_id INT NOT NULL, index_id INT NOT NULL, column_name STRING, "
                     "key_ordinal INT, is_included BOOLEAN, is_descending BOOLEAN",
    "fragmentation": "server_name STRING, database_id INT, object_id INT, index_id INT, partition_number INT, "
                     "avg_fragmentation_in_percent DOUBLE, page_count BIGINT, has_lob_data BOOLEAN, "
                     "is_view_without_ansi_nulls BOOLEAN, data_collection_time TIMESTAMP_NTZ",
    "statistics": "server_name STRING, database_id INT, object_id INT, stats_id INT, stats_name STRING, "
                  "table_row_count BIGINT, rows BIGINT, rows_sampled BIGINT, modification_counter BIGINT, "
                  "last_updated TIMESTAMP_NTZ",
    "command_log": "id INT NOT NULL, database_name STRING, schema_name STRING, object_name STRING, index_name STRING, "
                   "command_type STRING, command STRING, extended_info STRING, start_time TIMESTAMP_NTZ, "
                   "end_time TIMESTAMP_NTZ, error_number INT, error_message STRING",
    "backup_sets": "backup_set_id BIGINT NOT NULL, media_set_id BIGINT, server_name STRING, database_name STRING, "
                   "type STRING, is_copy_only BOOLEAN, backup_start_date TIMESTAMP_NTZ, "
                   "backup_finish_date TIMESTAMP_NTZ, backup_size DECIMAL(20,0), compressed_backup_size DECIMAL(20,0), "
                   "has_backup_checksums BOOLEAN",
    "backup_media": "media_set_id BIGINT NOT NULL, physical_device_name STRING, family_sequence_number INT",
    "backup_files": "database_name STRING NOT NULL, id INT NOT NULL, file_name STRING",
    "check_history": "id BIGINT NOT NULL, server_name STRING, database_name STRING, check_time TIMESTAMP_NTZ, "
                     "duration_seconds INT, errors INT, message STRING",
    "jobs": "job_id STRING NOT NULL, name STRING, enabled BOOLEAN, notify_level_email INT, notify_level_page INT, "
            "notify_level_netsend INT, notify_level_eventlog INT, email_operator STRING, page_operator STRING, "
            "netsend_operator STRING, eventlog_operator STRING, delete_level INT",
    "job_steps": "job_id STRING NOT NULL, step_id INT NOT NULL, step_name STRING, command STRING, "
                 "on_success_action INT, on_success_step_id INT, on_fail_action INT, on_fail_step_id INT",
    "job_history": "instance_id BIGINT NOT NULL, job_id STRING, step_id INT, run_date INT, run_time INT, "
                   "run_duration INT, run_status INT",
    "job_schedules": "job_id STRING NOT NULL, freq_type INT, freq_interval INT, freq_relative_interval INT, "
                     "freq_subday_type INT, freq_subday_interval INT, active_start_time INT, active_end_time INT",
    "principals": "principal_id INT NOT NULL, sid BINARY, name STRING, type STRING",
    "role_members": "role_id INT NOT NULL, member_id INT NOT NULL",
    "grants": "grantee_id INT NOT NULL, class_desc STRING, object_name STRING, column_name STRING, "
              "permission STRING, state STRING",
    "logins": "login_id INT, login_name STRING, sid BINARY, is_disabled BOOLEAN",
    "columns": "database_name STRING, schema_name STRING, table_name STRING, column_name STRING, data_type STRING, "
               "max_length INT, is_nullable BOOLEAN, is_computed BOOLEAN, default_definition STRING",
    "modules": "database_name STRING, schema_name STRING, name STRING, type_desc STRING, definition STRING",
    "xml_events": "row_id BIGINT NOT NULL, event_name STRING, event_data STRING",
}


def schema(name: str) -> T.StructType:
    """The declared StructType of an input."""
    return T.StructType.fromDDL(SCHEMAS[name])
