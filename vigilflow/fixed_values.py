"""Fixed values.

Word lists, thresholds, transition tables and sentence formats that define the
results.  They are data, not logic: each one must keep exactly this value for a
query to give the right answer.
"""

# --- Fixed values: severities, statuses -------------------------------------
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
OPEN_ALERT_STATUSES = ["NEW", "ACKNOWLEDGED"]
ALERT_STATUSES = ["NEW", "ACKNOWLEDGED", "RESOLVED"]
SECURITY_ALERT_STATUSES = ["NEW", "ACKNOWLEDGED", "RESOLVED", "FALSE_POSITIVE"]
INCIDENT_STATUSES = ["OPEN", "ACKNOWLEDGED", "INVESTIGATING", "CONTAINED", "RESOLVED"]
ACTIVE_INCIDENT_STATUSES = ["OPEN", "ACKNOWLEDGED", "INVESTIGATING", "CONTAINED"]
ANOMALY_LABELS = ["ANOMALOUS", "ANOMALY", "OUTLIER"]

# --- Fixed values: lifecycle rules ------------------------------------------
ALERT_TRANSITIONS = {
    "NEW": ["ACKNOWLEDGED", "RESOLVED"],
    "ACKNOWLEDGED": ["RESOLVED"],
    "RESOLVED": [],
}
INCIDENT_TRANSITIONS = {
    "OPEN": ["ACKNOWLEDGED", "RESOLVED"],
    "ACKNOWLEDGED": ["INVESTIGATING", "CONTAINED", "RESOLVED"],
    "INVESTIGATING": ["CONTAINED", "RESOLVED"],
    "CONTAINED": ["RESOLVED"],
    "RESOLVED": [],
}
MIN_RESOLUTION_LENGTH = 5

# --- Fixed values: audit actions --------------------------------------------
LOGIN_FAILURE = "LOGIN_FAILURE"
ACCESS_DENIED = "ACCESS_DENIED"
RATE_LIMIT_EXCEEDED = "RATE_LIMIT_EXCEEDED"
INCIDENT_AUDIT_ACTIONS = ["INCIDENT_ASSIGNED", "INCIDENT_STATUS_CHANGED"]
AUDIT_ACTIONS = [
    "LOGIN_SUCCESS", "LOGIN_FAILURE", "LOGOUT", "ACCESS_DENIED", "PREDICTION_CREATED",
    "ALERT_ACKNOWLEDGED", "ALERT_RESOLVED", "WEBSOCKET_AUTH_SUCCESS", "WEBSOCKET_AUTH_FAILURE",
    "RATE_LIMIT_EXCEEDED", "ANALYTICS_VIEWED", "THREAT_INTELLIGENCE_LOOKUP", "INVESTIGATION_VIEWED",
    "INCIDENT_CREATED", "INCIDENT_ASSIGNED", "INCIDENT_STATUS_CHANGED", "INCIDENT_NOTE_ADDED",
    "INCIDENT_VIEWED", "REPORT_GENERATED", "REPORT_EXPORTED", "INCIDENT_EVIDENCE_EXPORTED",
    "THREAT_HUNT_SEARCHED", "SOURCE_INVESTIGATION_VIEWED", "THREAT_HUNT_HISTORY_VIEWED",
    "SECURITY_ERROR",
]
AUDIT_OUTCOMES = ["SUCCESS", "FAILURE", "DENIED"]
AUDIT_RESOURCES = [
    "AUTH", "ACCESS_CONTROL", "PREDICTION", "ALERT", "WEBSOCKET", "RATE_LIMIT", "ANALYTICS",
    "THREAT_INTELLIGENCE", "INCIDENT", "REPORT", "EVIDENCE", "HUNTING", "SYSTEM",
]

# --- Fixed values: raw label -> threat class, tried in this order -----------
LABEL_CLASSES = {
    "benign": "BENIGN",
    "normal": "BENIGN",
    "dos hulk": "DoS",
    "dos goldeneye": "DoS",
    "dos slowloris": "DoS",
    "dos slowhttptest": "DoS",
    "ddos": "DDoS",
    "portscan": "Port Scan",
    "port scan": "Port Scan",
    "ftp-patator": "Brute Force",
    "ssh-patator": "Brute Force",
    "web attack – xss": "Web Attack",
    "web attack – sql injection": "Web Attack",
    "web attack – brute force": "Web Attack",
    "web attack - xss": "Web Attack",
    "web attack - sql injection": "Web Attack",
    "web attack - brute force": "Web Attack",
    "bot": "Bot",
    "infiltration": "Infiltration",
    "heartbleed": "DoS",
}
OTHER_ATTACK = "Other Attack"
BENIGN = "BENIGN"
LABEL_COLUMNS = ["label", "class", "attack_cat", "threat_type"]
PROFILE_LABEL_COLUMNS = ["label", "Label", "LABEL", "class", "Class", "attack_cat", "threat_type"]
SCORING_TARGET_COLUMNS = ["label", "class", "threat_type"]

# --- Fixed values: column name patterns -------------------------------------
IDENTIFIER_PATTERNS = [
    "flow_id", "flow id", "source_ip", "src_ip", "source ip", "destination_ip",
    "dst_ip", "dest ip", "timestamp", "session_id", "record_id",
]
PROFILE_IDENTIFIER_PATTERNS = ["flow_id", "flow id", "timestamp", "session_id", "record_id"]
INFINITY_WORDS = ["Infinity", "-Infinity", "Inf", "-Inf"]
DROP_REASON_IDENTIFIER = (
    "Identifier column dropped to prevent model overfitting to specific host/time attributes."
)
DROP_REASON_CONSTANT = "Constant column (zero variance, provides no discriminative signal)."
PROBLEM_CONSTANT = "Constant column (0 or 1 unique values, zero variance)"
PROBLEM_MISSING = "Severe missing rate (%s%%)"
PROBLEM_INFINITE = "Contains %d infinite values (e.g. divide-by-zero)"

# --- Fixed values: input column candidates for the flow features ------------
FEATURE_INPUTS = {
    "fwd_packets": ["total_fwd_packets", "total_fwd_packet", "fwd_packets"],
    "bwd_packets": ["total_backward_packets", "total_bwd_packets", "bwd_packets"],
    "fwd_bytes": ["total_length_of_fwd_packets", "total_fwd_bytes", "fwd_bytes"],
    "bwd_bytes": ["total_length_of_bwd_packets", "total_bwd_bytes", "bwd_bytes"],
    "duration": ["flow_duration", "duration", "duration_seconds"],
    "packets": ["total_packets", "tot_pkts"],
    "bytes": ["total_bytes", "tot_bytes"],
    "syn": ["syn_flag_count", "syn_count", "syn_flags", "fwd_psh_flags"],
    "rst": ["rst_flag_count", "rst_count", "rst_flags"],
    "destination_port": ["destination_port", "dst_port", "dport"],
}
MIN_DURATION = 1e-6
MICROSECOND_MEDIAN = 1000.0

# --- Fixed values: telemetry aliases of a scored flow -----------------------
TELEMETRY_ALIASES = {
    "source_ip": ["source_ip", "Source IP", "src_ip"],
    "destination_ip": ["destination_ip", "Destination IP", "dst_ip"],
    "source_port": ["source_port", "Source Port", "src_port"],
    "destination_port": ["destination_port", "Destination Port", "dst_port"],
    "protocol": ["protocol", "Protocol"],
    "flow_duration": ["flow_duration", "Flow Duration", "duration"],
    "total_forward_packets": ["total_fwd_packets", "Total Fwd Packets", "total_forward_packets"],
    "total_backward_packets": ["total_backward_packets", "Total Backward Packets", "total_bwd_packets"],
    "fwd_bytes": ["total_length_of_fwd_packets", "Total Length of Fwd Packets"],
    "bwd_bytes": ["total_length_of_bwd_packets", "Total Length of Bwd Packets"],
    "total_bytes": ["total_bytes", "Total Bytes"],
}
COMPACT_JSON_FIELDS = 25

# --- Fixed values: quantile bounds, model settings --------------------------
CLIP_QUANTILES = (0.0001, 0.9999)
FOREST_TREES = 150
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.05
CLASSIFIER_TREES = 100
CLASSIFIER_DEPTH = 16
SEED = 42
TEST_SHARE = 0.30

# --- Fixed values: triage ----------------------------------------------------
ACTION_CRITICAL = "Immediate SOC Alert & Automated Host Triage"
ACTION_HIGH = "SOC Incident Queue Escalation"
ACTION_INSPECT = "Flow Telemetry Inspection & Behavioral Audit"
ACTION_DRIFT = "Log Deviation for Baseline Drift Analysis"
ACTION_LOW = "Standard Flow Logging"
ALERT_TYPES = {
    "CRITICAL": "CRITICAL_INTRUSION",
    "HIGH": "NETWORK_INTRUSION",
    "MEDIUM": "ANOMALY_MONITORING",
}
ANOMALY_TEXT = "Outlier divergence score: %.3f (0.0=nominal, 1.0=severe outlier)."
TRIAGE_TEXT = (
    "Flow evaluated: Anomaly=%s (score %.2f), Classification='%s' (est. prob %.1f%%). "
    "Assigned Risk Level: %s."
)
REMOTE_ACCESS_PORTS = [21, 22, 23, 3389]
WEB_PORTS = [80, 443, 8080, 8443]
DNS_PORT = 53
REASON_SEVERE = "Severe anomaly divergence (score: %.3f) detected by Isolation Forest"
REASON_ELEVATED = "Elevated statistical outlier score (%.3f) above nominal traffic baseline"
REASON_CLASS = "Supervised Random Forest classified flow signature as '%s' attack vector"
REASON_SURE = "High classifier confidence (%.1f%%) supporting threat designation"
REASON_UNSURE = "Moderate classifier confidence (%.1f%%); recommends secondary validation"
REASON_REMOTE = "Target involves administrative remote access service (port %d)"
REASON_WEB = "Target involves public web application service (port %d)"
REASON_DNS = "Target involves core DNS resolution infrastructure (port 53)"
REASON_RISK = "Composite risk assessment assigned %s priority based on combined anomaly and threat scores"
REASON_BENIGN = "Flow telemetry metrics conform to expected baseline benign traffic patterns"
REASON_DEFAULT = "Standard baseline network flow evaluation"

# --- Fixed values: hunting and reports ---------------------------------------
TIME_RANGES = {
    "1h": (1, "Last 1 Hour"),
    "24h": (24, "Last 24 Hours"),
    "7d": (24 * 7, "Last 7 Days"),
    "30d": (24 * 30, "Last 30 Days"),
}
MAX_RANGE_DAYS = 90
MAX_HUNT_ROWS = 200
MAX_REPORT_ROWS = 1000
MAX_PAGE_ROWS = 100
MAX_HISTORY_ROWS = 50
TOP_DESTINATIONS = 15
TOP_AUDIT_ROWS = 10
LIVE_FEED_ROWS = 20
BURST_HITS = 3
BURST_SECONDS = 600
CONVERGENCE_HITS = 2
CONVERGENCE_HIGH_HITS = 5
CASE_INSIGHTS = 3
HISTORY_SUMMARY_CHARS = 250
CONVERGENCE_TITLE = "Repeated Probe / Attack Convergence from %s"
CONVERGENCE_TEXT = (
    "Source IP '%s' generated %d matching flow predictions targeting destination port(s): %s."
)
CASE_TITLE = "Associated SOC Incident Case: %s"
CASE_TEXT = (
    "Active case '%s' (%s, status %s) shares search attributes with current threat hunt results."
)
BURST_TITLE = "Short-Duration Event Burst Detected"
BURST_TEXT = (
    "Observed %d suspicious flows within a tight %d minute window. "
    "Indicates potential automated script or tool."
)
FINDING_EMPTY = "Zero network flow evaluations were logged within this timeframe."
FINDING_DENSITY = (
    "Observed %d suspicious/anomalous flows out of %d total evaluations (%.1f%% anomaly density)."
)
FINDING_ALERTS = (
    "High-priority alert volume: %d CRITICAL and %d HIGH severity alerts triggered."
)
FINDING_RESOLUTION = (
    "SOC Incident Resolution Rate: %.1f%% (%d resolved, %d open/in-progress)."
)
FINDING_VECTOR = "Primary detected attack vector: '%s' with %d matching event signatures."
FINDING_SOURCE = "Most active source address: '%s' with %d associated ingress flows."

# --- Fixed values: timelines -------------------------------------------------
EVENT_FLOW_TEXT = "Flow evaluated as %s (%s risk, score %.2f)."
EVENT_ALERT_TEXT = "Security alert #%d (%s) triggered: %s."
EVENT_INCIDENT_TEXT = "SOC Incident %s opened: '%s'."
CASE_CREATED_TEXT = "Incident %s created with severity %s."
CASE_ACKNOWLEDGED_TEXT = "Incident acknowledged and triaged."
CASE_INVESTIGATION_TEXT = "Active forensic investigation initiated."
CASE_RESOLVED_TEXT = "Incident resolved: %s"
CASE_NOTE_LONG_TEXT = "Analyst note added: %s..."
CASE_NOTE_TEXT = "Analyst note: %s"
CASE_ALERT_TEXT = "Linked Alert #%d (%s, severity %s)."
CASE_PREDICTION_TEXT = "Linked Prediction #%d (%s, risk %s)."
CASE_AUDIT_TEXT = "Audit event: %s"
NOTE_PREVIEW_CHARS = 80
EVIDENCE_CREATED_TEXT = "Incident %s created with initial status OPEN."
EVIDENCE_ACKNOWLEDGED_TEXT = "Incident acknowledged by security operator."
EVIDENCE_INVESTIGATION_TEXT = "Deep forensic investigation commenced."
EVIDENCE_RESOLVED_TEXT = "Incident resolved. Remediation: %s"

# --- Fixed values: intelligence miss, inheritance ----------------------------
INTEL_SOURCE = "LOCAL_DEMO_INTELLIGENCE"
INTEL_UNKNOWN = "UNKNOWN"
INTEL_MISS_NOTE = "No reputation record found in local demonstration threat intelligence base."
DEFAULT_SEVERITY = "HIGH"
DEFAULT_CATEGORY = "Suspicious Network Activity"

# --- Fixed values: privacy ---------------------------------------------------
FORBIDDEN_KEYS = [
    "password", "password_hash", "hashed_password", "token", "access_token",
    "authorization", "secret", "secret_key", "cookie", "jwt", "credentials",
]
FORBIDDEN_TEXT = ["bearer ", "password", "token"]
REDACTED = "[REDACTED]"
SCRUBBED_TEXT = '{"note": "Sanitized unformatted detail"}'

# --- Fixed values: payload rules ---------------------------------------------
BAD_KEY_PATTERN = "[<>{}$\\[\\];'\"`]"
BAD_NUMBER_WORDS = ["nan", "inf", "-inf", "+inf", "infinity", "-infinity"]
SAFE_TEXT_PATTERN = "^[a-zA-Z0-9_\\-.\\s]+$"

# --- Fixed values: rate limits per minute ------------------------------------
RATE_LIMITS = {"login": 5, "predict": 60, "read": 120, "mutation": 30}

# --- Fixed values: severity score weights (confidence, outlier, asset) -------
SEVERITY_WEIGHTS = (0.4, 0.3, 0.3)

# --- Fixed values: retention --------------------------------------------------
AUDIT_RETENTION_DAYS = 90

# --- Fixed values: numeric fields of a flow payload ---------------------------
FLOW_NUMERIC_FIELDS = [
    "destination_port", "flow_duration", "total_fwd_packets", "total_backward_packets",
    "total_length_of_fwd_packets", "total_length_of_bwd_packets", "fwd_packet_length_max",
    "fwd_packet_length_min", "fwd_packet_length_mean", "bwd_packet_length_mean",
    "flow_bytes_per_s", "flow_packets_per_s", "flow_iat_mean", "flow_iat_std", "flow_iat_max",
    "flow_iat_min", "fwd_psh_flags", "bwd_psh_flags", "fwd_header_length", "bwd_header_length",
    "fwd_packets_per_s", "bwd_packets_per_s", "min_packet_length", "max_packet_length",
    "packet_length_mean", "packet_length_std", "fin_flag_count", "syn_flag_count",
    "rst_flag_count", "psh_flag_count", "ack_flag_count", "urg_flag_count",
    "down_per_up_ratio", "average_packet_size", "protocol",
]
