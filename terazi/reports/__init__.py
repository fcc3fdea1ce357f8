"""Reports in English and Turkish, rendered on the driver from small frames."""
