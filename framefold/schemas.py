"""Schemas of the engine's tables."""

MARKER = "struct<kind:string,value:double>"
CHUNK = "stream_id string, seq long, data binary"
FRAME = f"stream_id string, frame_id long, audio_data binary, timestamp_ms double, vad_result {MARKER}, sample_rate int, frame_size int"
SEGMENT = f"stream_id string, segment_id long, audio_data binary, start_timestamp_ms double, end_timestamp_ms double, frame_count long, start_vad_result {MARKER}, end_vad_result {MARKER}, sample_rate int"
FRAME_STRUCT = f"struct<frame_id:long,audio_data:binary,timestamp_ms:double,vad_result:{MARKER},sample_rate:int,frame_size:int>"
SEGMENT_STRUCT = f"struct<segment_id:long,audio_data:binary,start_timestamp_ms:double,end_timestamp_ms:double,frame_count:long,start_vad_result:{MARKER},end_vad_result:{MARKER},sample_rate:int>"
RESULT = f"stream_id string, result_type string, frame {FRAME_STRUCT}, segment {SEGMENT_STRUCT}, processing_time_ms double, instance_id string"
SAMPLE_CHUNK = "data array<float>, sequence_number long, start_frame long, chunk_size int, overlap_size int, timestamp_ms double, sample_rate int, is_last boolean, metadata map<string,string>"
VAD_RESULT = "audio_chunk array<float>, is_speech boolean, probability double, start_ms double, end_ms double, chunk_id long, confidence double, energy_level double, snr_db double, speech_type string, metadata map<string,string>, is_compensated boolean, original_start_ms double"
VAD_SEGMENT = "start_ms double, end_ms double, confidence double, peak_probability double, chunk_count long, energy_stats map<string,double>"
AUDIO_METADATA = "title string, duration_seconds double, file_size long, encoding string, bitrate int, created_at timestamp, source string, quality string"
STATS = "total_chunks_processed long, total_processing_time_ms double, average_processing_time_ms double, speech_segments long, single_frames long, speech_ratio double, throughput_chunks_per_second double, memory_usage_mb double, error_count long, error_rate double"
BUFFER_STATUS = "capacity long, available_samples long, free_samples long, usage_ratio double, status_level string, overflow_count long, underflow_count long"
SYSTEM_STATUS = "status string, uptime_seconds double, active_instances int, warnings array<string>"
