"""Sources: file and Kafka readers, the driver-table bridge."""
