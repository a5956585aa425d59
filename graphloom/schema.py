"""Table schemas. NULL means that an attribute is absent; readers of an attribute apply its default."""

NODES = (
    "id string, type string, description string, mgmt_address string, capabilities array<string>, sys_descr string, "
    "sys_location string, uptime bigint, interface_count int, utilization double, error_rate double, extra map<string,string>"
)
EDGES = (
    "src string, dst string, orig_src string, orig_dst string, local_port string, remote_port string, protocol string, "
    "edge_id string, ttl int, prefix string, metric int, admin_distance int, interface string, oper_status string, "
    "speed_mbps int, utilization_in double, utilization_out double, error_rate double, input_rate_bps double, "
    "output_rate_bps double, weight double, extra map<string,string>"
)
NEIGHBORS = (
    "local_device string, local_port string, remote_device string, remote_port string, remote_system_description string, "
    "remote_capabilities array<string>, remote_mgmt_address string, ttl int, protocol string, edge_id string, ordinal bigint"
)
ROUTES = (
    "source_router string, prefix string, mask_len int, network string, protocol string, next_hop string, "
    "next_hop_interface string, metric int, admin_distance int, age string, tag int, ordinal bigint"
)
INTERFACE_STATE = (
    "device string, name string, admin_status string, oper_status string, speed_mbps int, duplex string, mtu int, "
    "ip_address string, subnet_mask string, mac_address string, vlan int, description string, in_bytes bigint, "
    "out_bytes bigint, in_packets bigint, out_packets bigint, in_errors bigint, out_errors bigint, in_discards bigint, "
    "out_discards bigint, crc_errors bigint, collisions bigint, input_rate_bps double, output_rate_bps double, ts double, "
    "collection_method string"
)
