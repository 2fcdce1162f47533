"""Fixed schemas of readings, windows, runs, series, chunks and cases."""

from __future__ import annotations

#: Channels of a reading; c10 arrives as on/off or a boolean.
SENSORS = tuple(f"c{i}" for i in range(1, 20))

READING = ", ".join(["gun_id string", "time timestamp_ntz", *[f"{c} {'string' if c == 'c10' else 'double'}" for c in SENSORS], "error string"])
RUN = "gun_id string, state string, code string, start_ts timestamp_ntz, end_ts timestamp_ntz, dur_s double, rows long"
SERIES = "event_id string, channel string, offset int, value double"
CHUNK = "chunk_id string, doc string, page int, source_pages array<int>, chunk_index int, section string, unit_kind string, text string, searchable boolean, review_needed boolean, embedding array<float>, model string"
CASE = "case_id string, gun_id string, grp string, status string, severity string, detected_at timestamp_ntz, data string"
HANDOFF = (
    "event_id string, episode_id string, event_type string, gun_id string, detected_at timestamp, "
    "trigger struct<source:string,rule_code:string,rule_trigger_time:timestamp,anomaly_score:double,threshold:double,score_z:double,alarm_duration_s:double,sustained:boolean>, "
    "error_timeline array<struct<code:string,start:timestamp,end:timestamp,duration_s:double,class_hint:string>>, "
    "sensor_features struct<window_start:timestamp,window_end:timestamp,missing_s:array<int>,channels:map<string,array<struct<s:int,v:double>>>,error:array<struct<s:int,code:string>>>"
)
