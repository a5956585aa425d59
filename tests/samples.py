"""Short device outputs for tests, made up here."""

TEXTS = {
    "lldp": """System Name: hall-7.example.net
Local Port id: xe-0/2
Port id: et-5
Time To Live: 95
System Capabilities: Router, Bridge
Management Address: 10.40.7.1
System Description:
  hall switch
----------------------------------------
Local Intf: xe-0/3
System Name: desk-31
Port Description: lan
System Capabilities: telephone
----------------------------------------
Local Intf: xe-0/4
Port id: lost
""",
    "snmp": """# a walk
.1.3.6.1.2.1.1.5.0 = STRING: "mast-2.example"
1.3.6.1.2.1.2.2.1.2.9 = STRING: "antenna"
1.3.6.1.2.1.2.2.1.8.9 = INTEGER: 2
1.0.8802.1.1.2.1.4.1.1.9.0.9.1 = STRING: "mast-3"
1.0.8802.1.1.2.1.4.1.1.7.0.9.2 = STRING: "no name"
""",
    "ios": """Codes: O - OSPF
Gateway of last resort is not set

O E2  10.61.0.0/18 [110/9] via 10.60.0.9, 00:02:11, Te3/1
      10.62.0.0/20 is subnetted, 2 subnets
O IA  10.62.1.0/26 [110/12] via 10.60.0.8, 00:02:11, Te3/2
S     10.63.0.0/30 is directly connected, Vl12
""",
    "interfaces": """TenGigE0/0/0/3 is up, line protocol is up
  Hardware is TenGigE, address is 00de.ad01.0203 (bia 00de.ad01.0203)
  Internet address is 10.70.1.1/30
  MTU 9100 bytes, BW 10000000 Kbit/sec
     3000 packets input, 1 bytes
     4 input errors, 0 CRC
     1000 packets output, 1 bytes
     2 output errors, 0 collisions
TenGigE0/0/0/4 is administratively down, line protocol is down
  MTU 9100 bytes, BW 10000000 Kbit/sec
""",
}
