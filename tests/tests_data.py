"""Where the test data lies, and small tables."""

MIDDLE = "/root/testdata/sf0.01"

CREW = [
    {"id": 1, "name": "ines", "years": 4, "port_id": 7, "port": "gdansk"},
    {"id": 2, "name": "otto", "years": 9, "port_id": 8, "port": "lagos"},
    {"id": 3, "name": "ruth", "years": 21, "port_id": 7, "port": "gdansk"},
]
PORTS = [{"id": 7, "port_name": "gdansk"}, {"id": 8, "port_name": "lagos"}]
