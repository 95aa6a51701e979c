"""Attack schedules of public intrusion-detection captures, and the class of each attack's name."""

from __future__ import annotations

# Published attack times (local wall clock), hosts, and the classes that names belong to.

RAW_TO_CANONICAL = {
    "FTP-Patator": "brute_force", "SSH-Patator": "brute_force", "DoS-Slowloris": "dos", "DoS-Slowhttptest": "dos", "DoS-Hulk": "dos", "DoS-GoldenEye": "dos", "Heartbleed": "heartbleed",
    "WebAttack-BruteForce": "web_attack", "WebAttack-XSS": "web_attack", "WebAttack-SQLInjection": "web_attack", "Infiltration": "infiltration", "Infiltration-PortScan": "portscan", "Botnet-ARES": "botnet",
    "PortScan": "portscan", "DDoS-LOIT": "ddos", "FTP-BruteForce": "brute_force", "SSH-Bruteforce": "brute_force", "DoS-SlowHTTPTest": "dos", "DDoS-LOIC-HTTP": "ddos", "DDoS-LOIC-UDP": "ddos", "DDoS-HOIC": "ddos",
    "BruteForce-Web": "web_attack", "BruteForce-XSS": "web_attack", "SQL-Injection": "web_attack", "Bot": "botnet", "PortMap": "ddos", "NetBIOS": "ddos", "LDAP": "ddos", "MSSQL": "ddos", "UDP": "ddos", "UDP-Lag": "ddos",
    "SYN": "ddos", "NTP": "ddos", "DNS": "ddos", "SNMP": "ddos", "SSDP": "ddos", "WebDDoS": "ddos", "TFTP": "ddos",
}

KALI = ["205.174.165.73", "172.16.0.1"]
WEB = ["192.168.10.50", "205.174.165.68"]
UBUNTU12 = ["192.168.10.51", "205.174.165.66"]
SERVER1 = ["172.31.69.25", "18.217.21.148"]
SERVER2 = ["172.31.69.28", "18.218.83.150"]
LOIC = ["18.218.115.60", "18.219.9.1", "18.219.32.43", "18.218.55.126", "52.14.136.135", "18.219.5.43", "18.216.200.189", "18.218.229.235", "18.218.11.51", "18.216.24.42"]
BOTS = [
    "172.31.69.23", "18.217.218.111", "172.31.69.17", "18.222.10.237", "172.31.69.14", "18.222.86.193", "172.31.69.12", "18.222.62.221", "172.31.69.10", "13.59.9.106",
    "172.31.69.8", "18.222.102.2", "172.31.69.6", "18.219.212.0", "172.31.69.26", "18.216.105.13", "172.31.69.29", "18.219.163.126", "172.31.69.30", "18.216.164.12",
]
WEB_ATTACKER, INFILTRATOR = ["18.218.115.60"], ["13.58.225.34"]
INFECTED1, INFECTED2 = ["172.31.69.24", "18.221.148.137"], ["172.31.69.13", "18.216.254.154"]
DAY1, DAY2 = ["192.168.50.4"], ["192.168.50.1"]


def _attack(name: str, when: object, start: str, end: str, attackers: list[str] | None, victims: list[str] | None, subnet: str | None = None) -> dict:
    return {"name": name, "reason": name, ("day" if isinstance(when, int) else "date"): when, "start": start, "end": end, "attacker_ips": attackers, "victim_ips": victims, "victim_subnet": subnet}


CIC_IDS_2017 = {"dataset": "cic-ids-2017", "utc_offset": "-03:00", "attacks": [_attack(*a) for a in (
    ("FTP-Patator", "2017-07-04", "09:20", "10:20", KALI, WEB),
    ("SSH-Patator", "2017-07-04", "14:00", "15:00", KALI, WEB),
    ("DoS-Slowloris", "2017-07-05", "09:47", "10:10", KALI, WEB),
    ("DoS-Slowhttptest", "2017-07-05", "10:14", "10:35", KALI, WEB),
    ("DoS-Hulk", "2017-07-05", "10:43", "11:00", KALI, WEB),
    ("DoS-GoldenEye", "2017-07-05", "11:10", "11:23", KALI, WEB),
    ("Heartbleed", "2017-07-05", "15:12", "15:32", [*KALI, "172.16.0.11"], UBUNTU12),
    ("WebAttack-BruteForce", "2017-07-06", "09:20", "10:00", KALI, WEB),
    ("WebAttack-XSS", "2017-07-06", "10:15", "10:35", KALI, WEB),
    ("WebAttack-SQLInjection", "2017-07-06", "10:40", "10:42", KALI, WEB),
    ("Infiltration", "2017-07-06", "14:19", "14:35", KALI, ["192.168.10.8"]),
    ("Infiltration", "2017-07-06", "14:53", "15:00", KALI, ["192.168.10.25"]),
    ("Infiltration", "2017-07-06", "15:04", "15:45", KALI, ["192.168.10.8"]),
    ("Infiltration-PortScan", "2017-07-06", "15:04", "15:45", ["192.168.10.8"], None, "192.168.10.0/24"),
    ("Botnet-ARES", "2017-07-07", "10:02", "11:02", KALI, ["192.168.10.15", "192.168.10.9", "192.168.10.14", "192.168.10.5", "192.168.10.8"]),
    ("PortScan", "2017-07-07", "13:55", "14:36", KALI, WEB),
    ("PortScan", "2017-07-07", "14:51", "15:29", KALI, WEB),
    ("DDoS-LOIT", "2017-07-07", "15:56", "16:16", ["205.174.165.69", "205.174.165.70", "205.174.165.71", "172.16.0.1"], WEB),
)]}

_STAGES = (("2018-02-28", "10:50", "12:05", INFECTED1), ("2018-02-28", "13:42", "14:40", INFECTED1), ("2018-03-01", "09:57", "10:55", INFECTED2), ("2018-03-01", "14:00", "15:37", INFECTED2))

CIC_IDS_2018 = {"dataset": "cic-ids-2018", "utc_offset": "-04:00", "attacks": [_attack(*a) for a in (
    ("FTP-BruteForce", "2018-02-14", "10:32", "12:09", ["172.31.70.4", "18.221.219.4"], SERVER1),
    ("SSH-Bruteforce", "2018-02-14", "14:01", "15:31", ["172.31.70.6", "13.58.98.64"], SERVER1),
    ("DoS-GoldenEye", "2018-02-15", "09:26", "10:09", ["172.31.70.46", "18.219.211.138"], SERVER1),
    ("DoS-Slowloris", "2018-02-15", "10:59", "11:40", ["172.31.70.8", "18.217.165.70"], SERVER1),
    ("DoS-SlowHTTPTest", "2018-02-16", "10:12", "11:08", ["172.31.70.23", "13.59.126.31"], SERVER1),
    ("DoS-Hulk", "2018-02-16", "13:45", "14:19", ["172.31.70.16", "18.219.193.20"], SERVER1),
    ("DDoS-LOIC-HTTP", "2018-02-20", "10:12", "11:17", LOIC, SERVER1),
    ("DDoS-LOIC-UDP", "2018-02-20", "13:13", "13:32", LOIC, SERVER1),
    ("DDoS-LOIC-UDP", "2018-02-21", "10:09", "10:43", LOIC, SERVER2),
    ("DDoS-HOIC", "2018-02-21", "14:05", "15:05", LOIC, SERVER2),
    ("BruteForce-Web", "2018-02-22", "10:17", "11:24", WEB_ATTACKER, SERVER2),
    ("BruteForce-XSS", "2018-02-22", "13:50", "14:29", WEB_ATTACKER, SERVER2),
    ("SQL-Injection", "2018-02-22", "16:15", "16:29", WEB_ATTACKER, SERVER2),
    ("BruteForce-Web", "2018-02-23", "10:03", "11:03", WEB_ATTACKER, SERVER2),
    ("BruteForce-XSS", "2018-02-23", "13:00", "14:10", WEB_ATTACKER, SERVER2),
    ("SQL-Injection", "2018-02-23", "15:05", "15:18", WEB_ATTACKER, SERVER2),
    *(("Infiltration", date, start, end, INFILTRATOR, hosts) for date, start, end, hosts in _STAGES),
    ("Bot", "2018-03-02", "10:11", "11:34", ["18.219.211.138"], BOTS),
    ("Bot", "2018-03-02", "14:24", "15:55", ["18.219.211.138"], BOTS),
)], "quarantine": [_attack("unlabellable-second-stage", date, start, end, None, hosts) for date, start, end, hosts in _STAGES]}

CIC_DDOS_2019 = {"dataset": "cic-ddos-2019", "days": {1: {"date": "2018-11-03", "utc_offset": "-03:00"}, 2: {"date": "2018-12-01", "utc_offset": "-04:00"}}, "attacks": [_attack(n, day, start, end, None, DAY1 if day == 1 else DAY2) for n, day, start, end in (
    ("PortMap", 1, "09:43", "09:51"),
    ("NetBIOS", 1, "10:00", "10:09"),
    ("LDAP", 1, "10:21", "10:30"),
    ("MSSQL", 1, "10:33", "10:42"),
    ("UDP", 1, "10:53", "11:03"),
    ("UDP-Lag", 1, "11:14", "11:24"),
    ("SYN", 1, "11:28", "17:35"),
    ("NTP", 2, "10:35", "10:45"),
    ("DNS", 2, "11:06", "11:16"),
    ("LDAP", 2, "11:22", "11:32"),
    ("MSSQL", 2, "11:36", "11:45"),
    ("NetBIOS", 2, "11:50", "12:00"),
    ("SNMP", 2, "12:12", "12:23"),
    ("SSDP", 2, "12:27", "12:37"),
    ("UDP", 2, "12:45", "13:09"),
    ("UDP-Lag", 2, "13:11", "13:15"),
    ("WebDDoS", 2, "13:18", "13:29"),
    ("SYN", 2, "13:29", "13:34"),
    ("TFTP", 2, "13:35", "17:15"),
)], "quarantine": [_attack("inter-window-residue", day, start, end, None, DAY1 if day == 1 else DAY2) for day, start, end in (
    (1, "09:52", "10:00"), (1, "10:10", "10:21"), (1, "10:31", "10:33"), (1, "10:43", "10:53"), (1, "11:04", "11:14"), (1, "11:25", "11:28"),
    (2, "10:46", "11:06"), (2, "11:17", "11:22"), (2, "11:33", "11:36"), (2, "11:46", "11:50"), (2, "12:01", "12:12"), (2, "12:24", "12:27"), (2, "12:38", "12:45"), (2, "13:10", "13:11"), (2, "13:16", "13:18"),
)]}

SCHEDULES = {m["dataset"]: m for m in (CIC_IDS_2017, CIC_IDS_2018, CIC_DDOS_2019)}
