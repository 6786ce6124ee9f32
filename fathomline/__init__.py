"""fathomline: table analytics as lazy DataFrame -> DataFrame functions on Spark."""
