"""Column types of the data model, as DDL."""

FRAMES = "video_id string, frame_idx bigint, pts_us bigint, width int, height int, px binary"
VIDEOS = (
    "video_id string, width int, height int, rotation int, duration_ms bigint, fps float, frame_count bigint, "
    "mime string, has_audio boolean, bitrate int, name string"
)
PACKETS = "video_id string, track string, pts_us bigint, is_key boolean, data binary"
JOBS = (
    "id bigint, uri string, model string, preset string, target string, sharpen float, anti_flicker boolean, hevc boolean, "
    "gpu boolean, start_ms bigint, end_ms bigint, color string, compute string, natural float"
)
JOB_EVENTS = "seq bigint, job_id bigint, action string"
HISTORY = "uri string, name string, res string, elapsed_s bigint, size_bytes bigint, ts_ms bigint, preset string, model string"
BACKENDS = "pos int, host string, fn_image int, fn_video int, args int, models array<string>"
PROBES = "host string, up boolean, latency_ms bigint, queue int"
REGISTRATIONS = "seq bigint, host string, session_start bigint, force boolean, is_tunnel boolean"
ATTEMPTS = "request_id bigint, rank int, ok boolean, result binary, error string"
CACHE = "key string, bytes binary, content_type string"
CLOUD_EVENTS = "seq bigint, line string"
