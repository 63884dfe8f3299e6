"""Writers of events, alerts, reports and archives."""
