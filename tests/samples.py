"""Machine events for tests."""

FIXED = {
    "schema_version": 1, "business_date": "2026-06-29", "plant_id": "plant-a", "line_id": "line-1", "machine_id": "mc-101",
    "product_code": "gearbox-a", "operation": "assembly",
}


def sample_event(i):
    """The i-th event of 2026-06-29, a minute apart from 08:00: units 10 i, defects i - 1, cycle 800 + 10 i."""
    hour, minute = divmod(8 * 60 + i - 1, 60)
    counted = {"units_produced": 10 * i, "defect_count": i - 1, "cycle_time_ms": 800 + 10 * i}
    named = {"event_id": f"evt-20260629-{i:06d}", "work_order_id": f"wo-{1000 + i}", "event_time": f"2026-06-29T{hour:02}:{minute:02}:00Z"}
    return FIXED | counted | named
