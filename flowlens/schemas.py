"""Table layouts: columns with their kinds, and the mapping of each source to the unified schema."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Kind(NamedTuple):
    type: T.DataType
    limit: int | None  # largest value of an unsigned number
    default: str


# How each kind is stored. Counters are longs; only `u64w` keeps the whole unsigned 64-bit range.
KINDS = {
    "ts": Kind(T.TimestampType(), None, "as_of"),
    "str": Kind(T.StringType(), None, "''"),
    "ip": Kind(T.StringType(), None, "'0.0.0.0'"),
    "u8": Kind(T.ShortType(), 2**8 - 1, "0"),
    "u16": Kind(T.IntegerType(), 2**16 - 1, "0"),
    "u32": Kind(T.LongType(), 2**32 - 1, "0"),
    "u64": Kind(T.LongType(), 2**63 - 1, "0"),
    "u64w": Kind(T.DecimalType(20, 0), 2**64 - 1, "0"),
}


def columns(text: str) -> dict[str, str]:
    """`name kind` lines as an ordered mapping; a name without a kind is a string."""
    out = {}
    for line in text.split("\n"):
        if line.strip():
            name, _, kind = line.strip().partition(" ")
            out[name] = kind.strip() or "str"
    return out


def struct(cols: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, KINDS[k].type) for n, k in cols.items()])


# The key-value traffic table, in stored order.
KV_COLUMNS = columns("""
timestamp ts
raw_message
devname
devid
eventtime u64w
tz
logid
type
subtype
level
vd
srcip ip
srcport u16
srcintf
srcintfrole
dstip ip
dstport u16
dstintf
dstintfrole
srccountry
dstcountry
sessionid u64
proto u8
action
policyid u32
policytype
poluuid
policyname
service
trandisp
appcat
duration u32
sentbyte u64
rcvdbyte u64
sentpkt u32
rcvdpkt u32
sentdelta u32
rcvddelta u32
durationdelta u32
sentpktdelta u32
rcvdpktdelta u32
vpntype
""")

# Columns the pages ask for beside the stored ones: output name -> key in the line.
KV_EXTRA = {"username": "user", "hostname": "hostname"}

# The positional traffic table, in stored order.
TRAFFIC_COLUMNS = columns("""
timestamp ts
raw_message
device_name
serial
log_type
log_subtype
generated_time ts
received_time ts
session_id u64
repeat_count u32
src_ip ip
src_port u16
src_zone
src_interface
src_user
src_mac
dst_ip ip
dst_port u16
dst_zone
dst_interface
dst_user
dst_mac
nat_src_ip ip
nat_src_port u16
nat_dst_ip ip
nat_dst_port u16
rule_name
rule_uuid
application
app_category
app_subcategory
app_technology
app_risk u8
protocol u8
ip_protocol
action
bytes_sent u64
bytes_received u64
packets_sent u64
packets_received u64
session_start_time ts
elapsed_time u32
src_country
dst_country
src_location
dst_location
url_category
url_filename
threat_id
threat_category
severity
direction
device_group_hierarchy1
device_group_hierarchy2
device_group_hierarchy3
device_group_hierarchy4
vsys
vsys_name
sequence_number u64
action_flags
tunnel_type
tunnel_id u32
parent_session_id u64
parent_start_time ts
""")

# Positions (from 0) of the fields of a positional traffic line. A column named
# twice takes the later position where that field is not blank.
TRAFFIC_POSITIONS = [
    (1, "generated_time"), (2, "serial"), (3, "log_type"), (4, "log_subtype"), (6, "received_time"),
    (7, "src_ip"), (8, "dst_ip"), (9, "nat_src_ip"), (10, "nat_dst_ip"), (11, "rule_name"),
    (12, "src_user"), (13, "dst_user"), (14, "application"), (15, "vsys"), (16, "src_zone"),
    (17, "dst_zone"), (18, "src_interface"), (19, "dst_interface"), (20, "log_forwarding_profile"),
    (22, "session_id"), (23, "repeat_count"), (24, "src_port"), (25, "dst_port"),
    (26, "nat_src_port"), (27, "nat_dst_port"), (28, "action_flags"), (29, "ip_protocol"),
    (30, "action"), (31, "bytes_sent"), (32, "bytes_received"), (33, "packets_sent"),
    (34, "packets_received"), (35, "session_start_time"), (36, "elapsed_time"),
    (37, "app_category"), (38, "app_subcategory"), (39, "app_technology"), (40, "app_risk"),
    (41, "url_category"), (42, "src_country"), (43, "dst_country"), (44, "packets_sent"),
    (45, "packets_received"), (47, "device_group_hierarchy1"), (48, "device_group_hierarchy2"),
    (49, "device_group_hierarchy3"), (50, "device_group_hierarchy4"), (51, "vsys_name"),
    (52, "device_name"), (55, "src_mac"), (56, "dst_mac"), (58, "tunnel_type"), (59, "tunnel_id"),
    (61, "parent_session_id"), (62, "parent_start_time"), (63, "tunnel_type"),
    (70, "sequence_number"), (77, "src_location"), (78, "dst_location"), (80, "rule_uuid"),
]

# The short traffic schema (shared names of the key-value table) and its positions.
SLIM_COLUMNS = columns("""
timestamp ts
raw_message
devname
srcip ip
srcport u16
srcintf
dstip ip
dstport u16
dstintf
action
policyname
proto u8
appcat
dstcountry
sentbyte u64
rcvdbyte u64
sentpkt u32
rcvdpkt u32
username
""")
SLIM_POSITIONS = [
    (7, "srcip"), (8, "dstip"), (24, "srcport"), (25, "dstport"), (18, "srcintf"), (19, "dstintf"),
    (30, "action"), (11, "policyname"), (12, "username"), (29, "proto"), (37, "appcat"),
    (42, "dstcountry"), (32, "sentbyte"), (33, "rcvdbyte"), (44, "sentpkt"), (45, "rcvdpkt"),
]

# The web-access table, in stored order.
URL_COLUMNS = columns("""
timestamp ts
receive_time ts
generated_time ts
processing_timestamp ts
sequence_number u64
session_id u64
device_name
serial_number
source_address
destination_address
nat_source_ip
nat_destination_ip
source_port u16
destination_port u16
source_zone
destination_zone
inbound_interface
outbound_interface
ip_protocol u8
protocol
url
url_domain
url_path
url_query
url_category
url_category_list
http_method
user_agent
referer
content_type
response_code u16
response_size u64
rule_name
rule_uuid
action
severity
direction
threat_id
threat_category
log_action
source_user
destination_user
application
application_category
source_country
destination_country
raw_message
log_type
log_subtype
virtual_system
""")

# Positions (from 0) of the named fields of a web-access line.
URL_POSITIONS = [
    (2, "serial_number"), (3, "log_type"), (4, "log_subtype"), (6, "generated_time"),
    (7, "source_address"), (8, "destination_address"), (9, "nat_source_ip"),
    (10, "nat_destination_ip"), (11, "rule_name"), (12, "source_user"), (13, "destination_user"),
    (14, "application"), (15, "virtual_system"), (16, "source_zone"), (17, "destination_zone"),
    (18, "inbound_interface"), (19, "outbound_interface"), (20, "log_action"), (22, "session_id"),
    (23, "repeat_count"), (24, "source_port"), (25, "destination_port"), (26, "nat_source_port"),
    (27, "nat_destination_port"), (28, "flags"), (29, "ip_protocol"), (30, "action"), (31, "url"),
    (32, "threat_id"), (33, "url_category"), (34, "severity"), (35, "direction"),
    (36, "sequence_number"), (37, "action_flags"), (38, "source_country"),
    (39, "destination_country"), (40, "content_type"), (41, "pcap_id"), (42, "file_digest"),
    (43, "cloud"), (44, "url_index"), (45, "user_agent"), (46, "file_type"), (47, "xff_address"),
    (48, "referer"), (49, "sender"), (50, "subject"), (51, "recipient"), (52, "report_id"),
    (53, "device_group_hierarchy_level_1"), (54, "device_group_hierarchy_level_2"),
    (55, "device_group_hierarchy_level_3"), (56, "device_group_hierarchy_level_4"),
    (57, "virtual_system_name"), (58, "device_name"), (59, "action_source"), (60, "source_vm_uuid"),
    (61, "destination_vm_uuid"), (62, "http_method"), (63, "tunnel_id_imsi"),
    (64, "monitor_tag_imei"), (65, "parent_session_id"), (66, "parent_start_time"),
    (67, "tunnel_type"), (68, "threat_category"), (69, "content_version"), (70, "sig_flags"),
    (71, "sctp_association_id"), (72, "payload_protocol_id"), (73, "http_headers"),
    (74, "url_category_list"), (75, "rule_uuid"), (76, "http2_connection"),
    (77, "dynamic_user_group_name"), (78, "xff_address"), (79, "source_device_category"),
    (80, "source_device_profile"), (81, "source_device_model"), (82, "source_device_vendor"),
    (83, "source_device_os_family"), (84, "source_device_os_version"), (85, "source_hostname"),
    (86, "source_mac_address"), (87, "destination_device_category"),
    (88, "destination_device_profile"), (89, "destination_device_model"),
    (90, "destination_device_vendor"), (91, "destination_device_os_family"),
    (92, "destination_device_os_version"), (93, "destination_hostname"),
    (94, "destination_mac_address"), (95, "container_id"), (96, "pod_namespace"), (97, "pod_name"),
    (98, "source_external_dynamic_list"), (99, "destination_external_dynamic_list"),
    (100, "host_id"), (101, "domain_edl"), (102, "source_dynamic_address_group"),
    (103, "destination_dynamic_address_group"), (104, "partial_hash"),
    (105, "high_resolution_timestamp"), (106, "reason"), (107, "justification"),
]

# The unified schema: each column with the column or SQL literal that fills it per source.
UNIFIED = [
    # unified            flows_kv       flows_pan            threats
    ("timestamp",        "timestamp",   "timestamp",         "timestamp"),
    ("raw_message",      "raw_message", "raw_message",       "raw_message"),
    ("src_ip",           "srcip",       "src_ip",            "source_address"),
    ("src_port",         "srcport",     "src_port",          "source_port"),
    ("dst_ip",           "dstip",       "dst_ip",            "destination_address"),
    ("dst_port",         "dstport",     "dst_port",          "destination_port"),
    ("action",           "action",      "action",            "action"),
    ("protocol",         "proto",       "protocol",          "protocol"),
    ("bytes_received",   "rcvdbyte",    "bytes_received",    "bytes_received"),
    ("bytes_sent",       "sentbyte",    "bytes_sent",        "bytes_sent"),
    ("packets_sent",     "sentpkt",     "packets_sent",      "packets_sent"),
    ("packets_received", "rcvdpkt",     "packets_received",  "packets_received"),
    ("elapsed_time",     "duration",    "elapsed_time",      "elapsed_time"),
    ("src_interface",    "srcintf",     "src_interface",     "inbound_interface"),
    ("dst_interface",    "dstintf",     "dst_interface",     "outbound_interface"),
    ("rule_name",        "policyname",  "rule_name",         "rule_name"),
    ("src_user",         "username",    "src_user",          "source_user"),
    ("src_country",      "srccountry",  "src_country",       "source_country"),
    ("dst_country",      "dstcountry",  "dst_country",       "destination_country"),
    ("log_source",       "'flows_kv'",  "'flows_pan'",       "'threats'"),
    ("device_name",      "devname",     "device_name",       "device_name"),
    ("application",      "''",          "application",       "application"),
    ("threat_id",        "''",          "''",                "type"),
    ("severity",         "''",          "''",                "log_action"),
    # asked for by the filters, beyond the 24 columns of the page
    ("app_category",     "appcat",      "app_category",      "application_category"),
    ("hostname",         "hostname",    "application",       "application"),
]
UNIFIED_KINDS = {
    "timestamp": "ts", "src_port": "u16", "dst_port": "u16", "protocol": "u8",
    "bytes_received": "u64", "bytes_sent": "u64", "packets_sent": "u64",
    "packets_received": "u64", "elapsed_time": "u32",
}
UNIFIED_SCHEMA = struct({row[0]: UNIFIED_KINDS.get(row[0], "str") for row in UNIFIED})
SOURCES = ("flows_kv", "flows_pan", "threats")
